"""Operators of a training-data pipeline: filters, near-duplicates, scans, encodings and archives."""
