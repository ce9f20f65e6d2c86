"""Graph similarity analytics on Spark."""
