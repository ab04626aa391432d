"""Training-data operators: deduplication, filtering, scoring and mixing of text corpora."""
