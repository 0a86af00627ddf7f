"""Column functions: text, tokens, markup, formatting."""
