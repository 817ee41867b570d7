"""viewforge functions."""
