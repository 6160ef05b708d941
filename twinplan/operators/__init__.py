"""Comparison of relations."""
