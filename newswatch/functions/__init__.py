"""Column functions: text, dates, scores, markup and urls."""
