"""Readers, validation and sinks of catalogue data."""
