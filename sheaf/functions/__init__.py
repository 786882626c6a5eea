"""Column functions: text, URLs and scholarly identifiers."""
