"""Small functions for the rows of one key, without Spark."""
