"""Head-to-head contest and market analytics on Spark."""
