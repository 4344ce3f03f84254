"""Training-data operators on Spark: extraction, mixing, scanning, scoring, tokenising and deduplication."""
