"""platewise: Spark-first search, ingestion and preparation of recipe-like catalogue data."""
