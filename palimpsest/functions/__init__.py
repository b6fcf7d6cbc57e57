"""Predicates over table columns."""
