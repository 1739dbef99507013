"""Vector recognition, catalog and training-data operators as Spark DataFrame jobs."""
