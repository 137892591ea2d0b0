"""Structured Streaming over the attempt log."""
