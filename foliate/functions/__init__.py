"""Column functions: geometry, text quality and Markdown."""
