"""Content-intelligence analytics on Spark."""
