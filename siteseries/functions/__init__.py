"""Column expressions: dates, numbers, text, and special functions."""
