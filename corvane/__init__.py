"""Spark-native analytics over labelled review text."""
