"""Governed table access and exchange as Spark jobs."""

__version__ = "0.1.0"
