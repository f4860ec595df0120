"""Comparison of pairs as they arrive."""
