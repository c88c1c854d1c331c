"""Operators for training data: duplicates, similar vectors, names, personal data, tokens, packing, language."""
