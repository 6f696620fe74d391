"""Training-data operators: deduplication, filtering, scanning, extraction and packing of text corpora."""
