"""Column expressions and constants."""
