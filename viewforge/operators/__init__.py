"""viewforge operators."""
