"""Searching with queries that arrive as files."""
