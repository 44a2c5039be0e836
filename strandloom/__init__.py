"""Spark-native analytics over ordered sequences of signed symbols."""

__version__ = "0.1.0"
