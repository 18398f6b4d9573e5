"""Structured Streaming jobs for the periodic-refresh features."""
