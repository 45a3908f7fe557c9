"""Readers and writers: tables, text, markup and zipped packages."""
