"""Plans of the contest library."""
