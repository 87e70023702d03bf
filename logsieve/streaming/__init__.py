"""Incremental detection with Structured Streaming."""
