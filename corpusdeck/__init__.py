"""Document-corpus trend analytics expressed as Spark DataFrame operations."""
