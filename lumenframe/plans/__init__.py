"""Registered queries: one per operator, each with DuckDB SQL of the same columns where SQL can express it."""
