"""Spark-native analytics for open-data grant records and short text corpora."""
