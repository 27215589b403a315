"""Spark-native audit of deletion from retrieval-augmented language models."""
