"""Column expressions. All are built-in Catalyst functions."""
