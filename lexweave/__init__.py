"""Word association and corpus analytics on Spark."""
