"""Training-data operators (language ID, near duplicates, decontamination, mixing, token files, ...)."""
