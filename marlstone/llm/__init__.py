"""Training-data operators: dedup, mixing, extraction, quality, packing, scoring and pseudonyms."""
