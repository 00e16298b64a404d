"""A Spark-first engine for document collections, ranked retrieval and operational analytics."""
