"""Business-record resolution and lead analytics as Spark DataFrame jobs."""
