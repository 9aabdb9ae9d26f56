"""Training-data operators: quality, privacy, chat trees, packing, near-duplicates, language-model scores, licenses, mixing, secrets."""
