"""Training-data operators: packing, extraction, scans, dedup, joins, encoding, search and filters."""
