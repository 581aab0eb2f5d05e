"""Queries composed of operators: piles, views, runs, seeds and repairs."""
