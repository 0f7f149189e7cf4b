"""Spark-native analytics for construction cost catalogues."""
