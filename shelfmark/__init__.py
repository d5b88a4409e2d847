"""Spark-native deduplication and cataloguing of large file corpora."""
