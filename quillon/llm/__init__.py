"""Training-data operators: deduplication, classification, packing, tokenising, media and sharding."""
