"""Spark-native sensitive-text analytics over whole corpora."""
