"""Column functions: text clean-up, tokens, markup and small vectors."""
