"""Training-data operators: language, duplicates, toxicity, tokens, pages, privacy, search, contamination, mixing, archives."""
