"""Readers of statements and writers of results."""
