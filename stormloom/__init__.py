"""Weather-radar scan analytics on Spark."""
