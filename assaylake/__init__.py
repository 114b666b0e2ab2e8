"""Analytics for laboratory experiments, written as PySpark DataFrame jobs."""
