"""Functions of the contest library."""
