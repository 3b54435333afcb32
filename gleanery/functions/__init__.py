"""Scalar functions as Column builders, and the query language."""
