"""Operations of a training-data pipeline: deduplication, scans, language, archives, tokens."""
