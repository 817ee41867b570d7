"""viewforge plans."""
