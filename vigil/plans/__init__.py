"""Composed experiments and the registered queries."""
