"""Column-expression helpers: hashing, tokens, text and ranking building blocks."""
