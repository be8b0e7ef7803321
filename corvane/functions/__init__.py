"""Column functions: text, scores, vectors."""
