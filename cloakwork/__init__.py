"""Sensitive-value discovery, review and masking over corpora, on Spark."""
