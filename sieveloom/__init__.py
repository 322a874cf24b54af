"""Spark-native question-bank engine."""
