"""Network-flow analytics as PySpark DataFrame operators and Structured Streaming jobs."""
