"""Spark-native analytics for sequence regulation experiments."""
