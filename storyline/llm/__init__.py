"""Training-data operators: quality rules, WARC archives, mixing, near-duplicate detection, packing, personal data, secrets."""
