"""Batch jobs over very large collections of source code and text, on Spark."""
