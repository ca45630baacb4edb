"""Whole batches, read views and the test queries."""
