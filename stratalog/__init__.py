"""Telemetry analytics on Spark: log search, metric expressions and data preparation operators."""
