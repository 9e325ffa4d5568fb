"""Readers and the case, item and page tables."""
