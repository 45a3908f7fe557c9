"""Vellum: document-corpus analytics as Spark DataFrame jobs."""
