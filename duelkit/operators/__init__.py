"""Operators of the contest library."""
