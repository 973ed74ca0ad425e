"""Readers, extractors, the generator and writers."""
