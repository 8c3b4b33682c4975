"""Spark-native analytics over a corpus of court opinions."""
