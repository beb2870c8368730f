"""Structured Streaming job, sinks and the change feed."""
