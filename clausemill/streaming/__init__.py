"""Incremental runs of the batch operators with Structured Streaming."""
