"""Spark-native analytics over layered script content."""
