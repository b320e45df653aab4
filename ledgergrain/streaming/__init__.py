"""Structured Streaming jobs over run events."""
