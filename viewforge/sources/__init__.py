"""viewforge sources."""
