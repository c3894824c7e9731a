"""Spark-native organisational memory and knowledge analytics."""
