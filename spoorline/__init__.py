"""Spark-native evidence-tracing analytics."""
