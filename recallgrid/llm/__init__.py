"""Training-data operators: packing, quality, secrets, search, dedup, media, toxicity, mixing."""
