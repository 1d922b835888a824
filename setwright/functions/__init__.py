"""Column expressions: text functions, and byte/number conversion."""
