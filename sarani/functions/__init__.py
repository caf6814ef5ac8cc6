"""Column functions: text, split-JSON, languages, linear tables."""
