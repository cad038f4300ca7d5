"""Column functions: contacts, dates, countries, skills and text extraction."""
