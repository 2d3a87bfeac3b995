"""Spark-native entity resolution and record linkage."""
