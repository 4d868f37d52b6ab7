"""Spark-native analytics for request activity, address prefixes and training corpora."""
