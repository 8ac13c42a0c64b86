"""Spark-native analytics over conversation corpora."""
