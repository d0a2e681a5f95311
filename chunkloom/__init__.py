"""Spark-native engine that turns document corpora into audited, retrieval-ready chunk datasets."""

__version__ = "0.1.0"
