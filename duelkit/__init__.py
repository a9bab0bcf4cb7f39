"""Spark jobs over large tables of pairwise contests."""
