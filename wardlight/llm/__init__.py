"""Training-data pipeline operators (line dedup, near-duplicate join, LM scoring, ...)."""
