"""Queries over the given tables, with independent SQL for each to be checked against."""
