"""Review-text analytics as plain Spark DataFrame functions."""
