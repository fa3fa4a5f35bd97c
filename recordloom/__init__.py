"""Spark-first analytics over long-lived knowledge records."""

__version__ = "0.1.0"
