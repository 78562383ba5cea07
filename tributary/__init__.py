"""Spark-native analytics over event data and large text corpora."""
