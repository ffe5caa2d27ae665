"""Pooled-screen analytics on Spark: DataFrame operators, sources, functions and query plans."""

__version__ = "0.1.0"
