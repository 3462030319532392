"""Operators of a training-data pipeline: deduplication, filtering, search, extraction and tokenising at corpus scale."""
