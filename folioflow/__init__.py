"""A PySpark engine that turns documents into segments, chunks, checks and rendered books."""
