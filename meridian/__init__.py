"""Meridian: a Spark-native vector analytics engine."""
