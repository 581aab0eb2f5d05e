"""Column expressions: text keys, catalogue fields, price and relevance rules."""
