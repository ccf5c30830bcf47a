"""Training-data operators: counting, cleaning, joining, scoring and sharding of text corpora."""
