"""Vehicle-telemetry analytics on Spark: DataFrame in, DataFrame out, batch and streaming."""

__version__ = "0.1.0"
