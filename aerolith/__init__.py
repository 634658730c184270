"""Spark-first analytics for hourly environmental time series."""

__version__ = "0.1.0"
