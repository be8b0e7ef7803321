"""Structured Streaming twins of the session operators."""
