"""Tracewell: evidence-linked chronology and graph operators as Spark DataFrame transformations."""

__version__ = "0.1.0"
