"""Spark-native text-to-catalogue engine."""

__version__ = "0.1.0"
