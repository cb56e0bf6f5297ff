"""DataFrame operators: segments, mentions, dates, claims, evidence, resolution, review, integrity."""
