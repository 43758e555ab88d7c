"""Spark-native analytics for paired robustness experiments."""
