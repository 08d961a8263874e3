"""Spark-native analytics for speech and text corpora."""
