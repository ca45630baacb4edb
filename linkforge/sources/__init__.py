"""Readers of landing folders, and the stores of registry, reviews and models."""
