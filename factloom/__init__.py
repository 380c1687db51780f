"""Document facts at scale, as Spark DataFrame operations."""
