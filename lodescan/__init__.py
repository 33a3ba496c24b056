"""Sensitive-data discovery and classification on Spark DataFrames."""

__version__ = "0.1.0"
