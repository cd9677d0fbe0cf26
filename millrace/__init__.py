"""Spark-native analytics for datasets of code-generation experiments."""
