"""Queries over the given tables and the SQL that states the same results."""
