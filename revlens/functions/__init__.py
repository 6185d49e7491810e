"""Column expressions: paths, text and calendar."""
