"""Training-data operators: dedup, sharding, mixing, decontamination, scoring, chat formatting, search, audits, quality rules."""
