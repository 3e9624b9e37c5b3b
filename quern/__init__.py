"""Quern: a Spark-native full-text retrieval engine."""
