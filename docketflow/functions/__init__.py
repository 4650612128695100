"""Column expressions: text, codes, dates and JSON values."""
