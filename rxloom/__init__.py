"""Spark-native integration and retrieval of regulatory label data."""
