"""Whole analyses, and the queries over the supplied tables."""
