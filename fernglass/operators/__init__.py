"""Filters, listings, ranking, retrieval, freshness and the write path as DataFrame operators."""
