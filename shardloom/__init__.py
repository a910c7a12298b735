"""Spark-native engine for sharded document retrieval and versioned key-value data."""

__version__ = "0.1.0"
