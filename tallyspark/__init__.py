"""Decision analytics as Spark DataFrame and SQL operators."""
