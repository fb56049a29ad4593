"""Column functions and typed expressions."""
