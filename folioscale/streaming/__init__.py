"""Structured Streaming pipelines and keyed state."""
