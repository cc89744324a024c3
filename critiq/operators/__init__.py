"""DataFrame -> DataFrame operators, grouped by analysis area."""
