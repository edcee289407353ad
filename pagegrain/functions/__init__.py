"""Layout analytics on Spark."""
