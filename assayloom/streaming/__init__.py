"""Structured Streaming jobs over arriving rows."""
