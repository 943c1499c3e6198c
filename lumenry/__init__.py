"""Lumenry: an analytics engine for observability data, built on PySpark DataFrames."""

__version__ = "0.1.0"
