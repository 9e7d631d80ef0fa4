"""Evidence-traced semantic-model analytics on Spark."""
