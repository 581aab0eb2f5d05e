"""Operators of a training-data pipeline: clean, select, deduplicate, tokenise, pack."""
