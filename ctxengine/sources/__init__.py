"""Readers and writers of context items."""
