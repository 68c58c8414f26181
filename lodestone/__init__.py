"""Spark-native document intelligence and training-data engine."""
