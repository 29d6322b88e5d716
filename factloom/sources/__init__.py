"""Readers and writers of the store's own formats."""
