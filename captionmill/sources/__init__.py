"""Readers, and tables derived from relational data."""
