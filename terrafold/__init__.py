"""Spark-native variable-resolution 2.5D mapping analytics."""
