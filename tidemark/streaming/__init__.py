"""Streaming forms of batch operators: an extension, not needed for any batch query."""
