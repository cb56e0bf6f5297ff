"""Column functions: spans, text, dates and content-derived identifiers."""
