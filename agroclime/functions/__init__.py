"""Column-level helpers built on Spark's own functions."""
