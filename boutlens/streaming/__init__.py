"""Structured Streaming jobs.  Each has a batch twin among the operators."""
