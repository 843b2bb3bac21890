"""Whole runs: parameters, report text and the command line."""
