"""Spark-native analytics for a news and calendar portal."""
