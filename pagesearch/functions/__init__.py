"""Column-expression building blocks (all built-in Spark functions)."""
