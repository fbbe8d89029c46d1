"""Sequence-alignment analytics on the DataFrame API of Apache Spark."""

__version__ = "0.1.0"
