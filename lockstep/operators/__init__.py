"""Positions, differences, layouts and sinks."""
