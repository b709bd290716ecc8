"""Spark-native engine for building, splitting and scoring paired function corpora."""

__version__ = "0.1.0"
