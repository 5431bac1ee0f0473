"""clickweave: clickstream and corpus analytics as plain Spark DataFrame programs."""
