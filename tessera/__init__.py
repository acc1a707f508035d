"""Spark-native analytics over filings, facts, retrieval, evaluations and experiments."""
