"""Change-impact analytics as PySpark DataFrame jobs."""
