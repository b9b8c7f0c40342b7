"""Operators over tables of context items."""
