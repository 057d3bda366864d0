"""Spark-native analytics for literature panels."""

__version__ = "0.1.0"
