"""Structured Streaming jobs over flow observations."""
