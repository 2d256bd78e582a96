"""Training-data operators: sharding, filtering, deduplication, mixing, search and token output."""
