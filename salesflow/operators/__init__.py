"""Relational operators: conform, metrics, exact quantile, data quality."""
