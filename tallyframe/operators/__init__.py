"""Operators on ledgers and word relations."""
