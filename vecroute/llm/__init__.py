"""Training-data operators: tokens, formats, deduplication, filtering and mixing."""
