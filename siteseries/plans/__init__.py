"""Queries over the given tables: each has a Spark plan and, where SQL can express it, an equivalent SQL text."""
