"""Training-data operators: quality, search, near-duplicates, tokens, privacy, sharding, mixing."""
