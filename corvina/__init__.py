"""Spark-native bibliographic corpus engine."""
