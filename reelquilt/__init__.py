"""Spark-native analytics for media and text collections."""

__version__ = "0.1.0"
