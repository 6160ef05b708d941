"""Equivalence of relations, model files and their rewrites on Spark; training-data operators in `llm`."""

__version__ = "0.2.0"
