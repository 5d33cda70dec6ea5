"""Positional comparison of large collections of text sequences, as Spark DataFrame expressions."""
