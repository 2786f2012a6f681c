"""Operators for large training data. Nothing else in the library imports this subpackage."""
