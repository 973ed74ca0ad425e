"""Column expressions: text, parsing, dates, formats and statistics."""
