"""Spark-native analytics and cross-dialect verification."""
