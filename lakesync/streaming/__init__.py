"""Structured Streaming twins of the incremental sync modes."""
