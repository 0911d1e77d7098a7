"""Spark-native catalogue, price, fingerprint and holdings analytics."""
