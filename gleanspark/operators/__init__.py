"""DataFrame operators over the index tables."""
