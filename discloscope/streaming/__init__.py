"""Structured Streaming forms of the live-article operators."""
