"""Log analytics as Spark DataFrame operators."""
