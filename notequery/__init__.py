"""Search, grounding and protection of large collections of text notes on Spark."""
