"""Structured Streaming forms of the time-driven operators."""
