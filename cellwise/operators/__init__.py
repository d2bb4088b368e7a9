"""Contingency cells, expected counts, scoring models and decision rules."""
