"""Possible-worlds analytics on Spark: uncertain tables, confidence, random variables, and data preparation."""

__version__ = "0.1.0"
