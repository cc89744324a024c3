"""Readers, schema alignment, raw-to-standard conversion and test views."""
