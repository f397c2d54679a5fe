"""Training-data operators: deduplication, mixing, decontamination, scoring and filtering of text corpora."""
