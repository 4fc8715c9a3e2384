"""Column functions: native Spark expressions only."""
