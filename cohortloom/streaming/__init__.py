"""Structured Streaming forms of per-subject summaries."""
