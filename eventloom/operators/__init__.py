"""Operators over event logs and their cases."""
