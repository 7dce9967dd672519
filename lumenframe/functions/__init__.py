"""Column functions: numeric semantics, scalars, strings, arrays and maps."""
