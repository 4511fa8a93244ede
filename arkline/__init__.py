"""Archive-catalog analytics on Spark."""
