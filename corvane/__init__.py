"""Spark-native text curation, evaluation, retrieval and session analytics."""
