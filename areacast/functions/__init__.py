"""Column builders: survey recodes and statistical expressions."""
