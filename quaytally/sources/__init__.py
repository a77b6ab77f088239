"""Readers and writers, and the mapping of given tables to the canonical ones."""
