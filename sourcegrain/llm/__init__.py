"""Training-data operators: cleaning, deduplication, search, tokens, archives and language-model scores."""
