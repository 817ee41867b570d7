"""viewforge streaming."""
