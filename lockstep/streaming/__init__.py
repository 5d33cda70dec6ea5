"""Sequences that arrive over time."""
