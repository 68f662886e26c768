"""Operators of a training-data pipeline: duplicates, quality, URLs, licences, packing, tokens, extraction."""
