"""Spark-native analytics for vector-search effort: exact neighbours, effort curves, policies, drift."""
