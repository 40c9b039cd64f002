"""Spark-native analytics for ranking vulnerability findings by real-world risk."""
