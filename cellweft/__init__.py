"""Spark-native analytics for paired expression and chromatin-accessibility data."""
