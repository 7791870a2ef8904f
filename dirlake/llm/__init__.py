"""Training-data operators: near duplicates, packing, language ID, language-model scoring and so on."""
