"""Structured Streaming versions of the keyed operators."""
