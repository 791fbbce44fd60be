"""Readers: documents of several formats as ordered blocks, and project tables."""
