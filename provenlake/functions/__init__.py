"""Column functions: hashes, text, vectors, claim differences."""
