"""Column functions: text, numbers, formats."""
