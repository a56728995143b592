"""Document-pack verification analytics as Spark DataFrame jobs."""
