"""Spark-native operators for timed segments, manifests, text and arrays."""
