"""Quern: question answering over document collections, written as Spark plans."""

__version__ = "0.1.0"
