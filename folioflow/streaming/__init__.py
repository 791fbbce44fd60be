"""Checks on translation files as they arrive."""
