"""Column expressions and row-picking helpers shared by the operators."""
