"""Operators for preparing training data: search, filters, near copies, packing, tokens and fingerprints."""
