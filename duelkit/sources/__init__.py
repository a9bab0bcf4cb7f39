"""Sources of the contest library."""
