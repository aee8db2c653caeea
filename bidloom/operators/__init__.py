"""Operators: DataFrame to DataFrame, lazy, with explicit order columns."""
