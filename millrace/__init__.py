"""Spark-native analytics over product, review and text tables."""
