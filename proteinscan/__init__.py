"""Protein database search on Spark: exact Smith-Waterman scores and deterministic top hits."""
