"""Operators of a training-data pipeline: filters, joins, searches, encoding, packing."""
