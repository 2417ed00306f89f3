"""Training-data operators: dedup, extraction, scoring, mixing and packing of text corpora."""
