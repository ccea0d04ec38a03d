"""Timeline-memory analytics on Spark."""
