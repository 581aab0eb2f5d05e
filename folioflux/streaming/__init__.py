"""Structured Streaming forms of the change feed and the run."""
