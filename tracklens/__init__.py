"""Spark-native analytics for surveillance-style trajectory reports."""
