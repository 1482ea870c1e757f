"""Training-data operators: licences, shards, leaks, near copies, tokens, personal data, toxicity, quality, packing, language."""
