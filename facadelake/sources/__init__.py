"""Readers, writers and the inspection store."""
