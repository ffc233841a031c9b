"""Column expressions: scalar rules of the library."""
