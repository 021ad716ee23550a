"""Whole jobs, generated fixtures and the query catalog."""
