"""Readers and writers of the supported stores and file forms."""
