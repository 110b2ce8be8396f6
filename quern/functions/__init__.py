"""Column functions: Unicode text, URLs and HTML."""
