"""Analytics over collections of scientific documents as Spark DataFrame operations."""
