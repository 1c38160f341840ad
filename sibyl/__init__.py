"""Spark-native analytics over forecasts, prices and outcomes."""
