"""Feature-tag counting on Spark: paired reads to per-cell feature counts."""
