"""Readers, writers and the relations that queries start from."""
