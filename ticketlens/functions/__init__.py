"""Column expressions: parsing, calendar, text and distribution functions."""
