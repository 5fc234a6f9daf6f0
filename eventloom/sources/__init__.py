"""Readers that bind tables and files to event logs."""
