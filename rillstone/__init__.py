"""Spark-native toolkit for multi-station environmental time series."""
