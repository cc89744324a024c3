"""Structured Streaming forms of the alert windows and of model scoring."""
