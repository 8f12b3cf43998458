"""Column functions: text, dates and vectors."""
