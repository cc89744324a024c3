"""Column-level helpers: rounding, safe casts, scalar broadcast, text rules."""
