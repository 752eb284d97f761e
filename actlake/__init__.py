"""Spark jobs over collections of structured legal documents."""

__version__ = "0.1.0"
