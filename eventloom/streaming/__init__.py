"""Incremental statistics over event streams."""
