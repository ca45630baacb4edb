"""Operators on DataFrames: candidates, scores, components, registry, reviews, models."""
