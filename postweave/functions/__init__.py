"""Column expressions: text, URLs, dates, JSON values and statuses."""
