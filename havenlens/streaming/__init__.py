"""Incremental jobs over Structured Streaming."""
