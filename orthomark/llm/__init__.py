"""Operators of a training-data pipeline: filters, de-duplication, search, scoring and packing of text."""
