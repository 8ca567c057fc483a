"""Column factories shared by the operators."""
