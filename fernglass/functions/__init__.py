"""Column functions and vector codecs."""
