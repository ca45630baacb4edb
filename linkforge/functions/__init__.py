"""Scalar functions on columns: text, similarity, identity."""
