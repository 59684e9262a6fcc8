"""Training-data operators: cleaning, duplicates, mixing, tokens, nearest neighbours."""
