"""tally: Spark-native tabular analysis (ingest, profile, overview, chunks,
vector retrieval, ad-hoc SQL, rollups)."""

__version__ = "0.1.0"
