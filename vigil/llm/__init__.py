"""Training-data operators (language id, quality, deduplication, mixing, search, tokenising, privacy, archives)."""
