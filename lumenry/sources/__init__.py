"""Readers and writers of observability formats."""
