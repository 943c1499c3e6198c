"""Conditions and queries as plans."""
