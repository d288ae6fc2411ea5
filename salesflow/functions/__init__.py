"""Column expressions (parsing, rounding, money)."""
