"""Operators of a training-data pipeline: filters, duplicates, extraction, tokens."""
