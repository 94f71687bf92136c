"""Training-data operators: tokenising, mixing, deduplication, classifiers, fingerprints and sharding."""
