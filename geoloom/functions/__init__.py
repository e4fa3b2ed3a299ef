"""Column expressions: geometry, text, tags and the like."""
