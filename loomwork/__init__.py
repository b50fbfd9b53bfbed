"""Spark-native analytics over time-interval events, token sequences and noisy multi-source labels."""
