"""Training-data operators: chat formatting, mixing, joins, decontamination, sharding, counts, dedup, extraction, language ID, search."""
