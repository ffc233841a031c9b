"""Readers, writers and the adapters of the fixture tables."""
