"""Operators for preparing training data; nothing else in litmill imports this subpackage."""
