"""Catalogue change detection and record linkage on Spark."""

__version__ = "0.1.0"
