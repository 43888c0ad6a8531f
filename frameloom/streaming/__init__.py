"""Streams with carried state, and their end."""
