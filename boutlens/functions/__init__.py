"""Column functions: text and names, numbers, dates, records."""
