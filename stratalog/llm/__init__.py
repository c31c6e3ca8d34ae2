"""Operators for training text: term frequencies, percentile digests, encoding, packing, quality."""
