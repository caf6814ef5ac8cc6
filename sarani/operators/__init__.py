"""DataFrame operators: HTML, tables, templates, families, rewriting, datasets, scores."""
