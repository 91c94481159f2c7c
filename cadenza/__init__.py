"""Cadenza: a PySpark-native analytics engine for timestamped interaction data."""
