"""Readers, writers and the table catalog."""
