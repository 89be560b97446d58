"""Readers, writers and table life cycle."""
