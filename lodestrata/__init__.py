"""Spark-native retrieval analytics over source files, documents and work items."""
