"""Training-data operators: dedup, fingerprints, sharding, tokenising, quality, licences, packing."""
