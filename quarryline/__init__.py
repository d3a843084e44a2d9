"""Spark-native operators for document, retrieval and trajectory data."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
