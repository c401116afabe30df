"""Column-level building blocks, all made of built-in Spark expressions."""
