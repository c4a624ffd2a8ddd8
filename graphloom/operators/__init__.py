"""Operators over DataFrames: graph queries, and the data operators of the core."""
