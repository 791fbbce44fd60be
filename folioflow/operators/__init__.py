"""Relational operators over blocks, segments, chunks, translations and glossaries."""
