"""Spark-native analytics over evidence-backed graphs of software systems."""
