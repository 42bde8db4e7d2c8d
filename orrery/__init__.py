"""Spark-native analytics: risk, indicators, news text, graphs, retrieval, alerts and streams."""
