"""Job-run analytics as PySpark DataFrame and Structured Streaming functions."""
