"""Spark-native engine for preparing language-model datasets and retrieval corpora."""
