"""Structured Streaming forms of the ledger and audit operators."""
