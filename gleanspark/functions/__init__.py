"""Column functions: text analysis, stemming, URLs, hashes, scores."""
