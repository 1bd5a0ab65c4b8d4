"""Training-data operators: deduplication, filtering, privacy, packing and sharding of text tables."""
