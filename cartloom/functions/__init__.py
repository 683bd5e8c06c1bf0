"""Column expressions and the fixed rule values they use."""
