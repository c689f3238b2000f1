"""paceline: typed ingest, constraint checks, query timing and comparison reports on Spark."""
