"""Spark-native analytics and retrieval over governed document collections."""
