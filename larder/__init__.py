"""Menu and search analytics as Spark DataFrame jobs."""
