"""Spark-native manufacturing quality analytics."""
