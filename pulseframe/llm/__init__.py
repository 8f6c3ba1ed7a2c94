"""Training-data operators: dedup, mixing, packing, extraction, archives, search, scoring, sharding."""
