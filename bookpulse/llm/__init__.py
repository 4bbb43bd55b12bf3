"""Training-data operators: tokenizers, near duplicates, decontamination, filters, archives."""
