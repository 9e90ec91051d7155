"""Tessera: a Spark-native index, search and corpus engine over ordinary Parquet tables."""

__version__ = "0.1.0"
