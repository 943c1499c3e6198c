"""Operators on points, metrics, spans, profiles and checks."""
