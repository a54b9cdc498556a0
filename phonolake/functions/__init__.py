"""Column functions: text, hashes, rates, scores, and the sequence functions that need Python."""
