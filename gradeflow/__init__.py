"""Post-training data preparation, scoring and run analytics as Spark DataFrame jobs."""
