"""Column functions: text, patterns, URLs, risk, numbering."""
