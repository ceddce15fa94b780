"""Spark-native hybrid retrieval over versioned, sectioned documents."""
