"""Spark-native vector, document and event analytics."""
