"""Searching a database: all scores, and the best hits of each query."""
