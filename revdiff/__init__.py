"""Batch comparison of document versions on Spark."""
