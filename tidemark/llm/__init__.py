"""Training-data operators: deduplication, decontamination, scoring, formatting, packing."""
