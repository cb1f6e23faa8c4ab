"""A Spark-first engine for panel data."""
