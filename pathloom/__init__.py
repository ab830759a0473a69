"""Causal network analytics on Spark: graph algebra, sufficient statistics and small models fitted in parallel."""

__version__ = "0.1.0"
