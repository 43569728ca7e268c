"""Operations of a training-data pipeline: near duplicates, tokens, neighbours, filters, mixing, output."""
