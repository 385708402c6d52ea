"""Operators of a training-data pipeline: quality, duplicates, tokens, mixing and extraction."""
