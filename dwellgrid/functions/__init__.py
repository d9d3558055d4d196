"""Column expressions and aggregate helpers."""
