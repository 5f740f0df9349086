"""Code-knowledge analytics as plain Spark DataFrame, SQL and Structured Streaming jobs."""
