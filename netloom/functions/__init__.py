"""Column expressions and geometry."""
