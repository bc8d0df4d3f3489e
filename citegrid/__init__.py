"""Spark-native analytics over research-paper records: ingest, retrieval, citation graph, streaming limits."""
