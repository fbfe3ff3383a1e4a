"""Operators for training data: duplicates, survivors, languages, personal data, tokens, packing, residue."""
