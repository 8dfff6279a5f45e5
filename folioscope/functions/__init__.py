"""Column expressions: text folding, tokens, labels and the rules that classify sources."""
