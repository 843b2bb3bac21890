"""Residue alphabet, substitution matrices and the alignment score."""
