"""Spark-native analytics for operational incidents."""
