"""Column functions: each takes and returns Columns and stays inside Spark's own expressions."""
