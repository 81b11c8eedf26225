"""Spark-native analytics for offline network-traffic forensics."""
