"""The formula language and column helpers."""
