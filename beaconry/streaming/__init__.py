"""Structured Streaming forms of the monitor."""
