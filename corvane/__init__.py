"""Spark-native analytics over vector state, revision logs and text corpora."""
