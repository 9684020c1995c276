"""A Spark-first engine that turns corpora of text into scored, deduplicated, reviewable facts."""
