"""Operators for large text corpora: de-duplication, search, tokens, filters, mixing, HTML."""
