"""Operators for large training corpora; nothing else in viewforge imports this subpackage."""
