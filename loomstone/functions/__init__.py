"""Column functions: text, records and similarities."""
