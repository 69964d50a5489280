"""Operators of a training-data pipeline: URL filters, dedup, decontamination,
secret scans, WARC files, sharding, mixing, language ID and quality rules."""
