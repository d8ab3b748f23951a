"""Spark-native quantitative-trait analytics."""
