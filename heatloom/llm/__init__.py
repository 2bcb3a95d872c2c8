"""Operators for preparing text corpora: records, filters, duplicates, search, packing, scores."""
