"""Spark-native analytics over ambiguity-preserving text lattices."""

__version__ = "0.1.0"
