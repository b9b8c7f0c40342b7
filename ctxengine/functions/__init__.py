"""Column functions: tokens, types, relevance, text."""
