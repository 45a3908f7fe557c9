"""Structured Streaming forms of the account and service operators."""
