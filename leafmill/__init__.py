"""leafmill: corpus analytics, near-duplicate detection and catalog maintenance on Spark DataFrames."""
