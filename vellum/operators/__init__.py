"""Relational operators over documents, segments, accounts and service logs."""
