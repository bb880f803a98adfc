"""Column functions: hashes, envelopes, canonical text, codecs."""
