"""Readers and writers for the project tables."""
