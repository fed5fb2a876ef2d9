"""Loads inside Structured Streaming."""
