"""Operators that prepare text corpora for training: rules, near-duplicates, tokens, packing."""
