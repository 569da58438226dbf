"""Spark-native analytics for multi-date satellite imagery held as tables."""

__version__ = "0.1.0"
