"""Detection-evaluation analytics on Spark."""
