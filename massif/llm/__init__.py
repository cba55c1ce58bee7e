"""Training-data operators: dedup, quality, scoring, mixing and packing of text documents."""
