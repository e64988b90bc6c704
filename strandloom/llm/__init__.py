"""Training-data operators: URL filters, sharding, deduplication, mixing, packing, extraction, quality rules and language ID."""
