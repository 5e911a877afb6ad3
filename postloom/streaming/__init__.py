"""Structured Streaming forms of the repeated-load operators."""
