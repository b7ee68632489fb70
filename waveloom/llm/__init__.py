"""Training-data operators: search, deduplication, scoring, archives and token files."""
