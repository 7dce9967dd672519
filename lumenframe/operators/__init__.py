"""Relational operators, the pandas-like surface and the builder algebra."""
