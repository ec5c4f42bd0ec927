"""Lexiweave: a PySpark-native text-mining and co-word-network engine."""

__version__ = "0.1.0"
