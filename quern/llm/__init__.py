"""Operators for preparing training text: packing, encoding, joins, archives, shards, scans and filters."""
