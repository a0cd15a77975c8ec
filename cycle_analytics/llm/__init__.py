"""Operations of a training-data pipeline: counts, deduplication, archives, search, filters, mixing, packing."""
