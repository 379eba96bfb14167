"""Tidemark: anomaly analytics for keyed price series, written on Spark DataFrames."""

__version__ = "0.1.0"
