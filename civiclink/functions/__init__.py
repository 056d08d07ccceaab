"""Column expressions: text, dates, URLs, identifiers, file types, JSON and name similarity."""
