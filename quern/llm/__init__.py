"""Training-data operators: language, duplicates, packing, contamination, toxicity, secrets, URLs, fingerprints, personal data."""
