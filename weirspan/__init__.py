"""River-structure safety analytics as Spark DataFrame jobs."""
