"""Composed loads and the query catalogue."""
