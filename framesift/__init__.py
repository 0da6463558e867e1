"""Media analytics on Spark."""
