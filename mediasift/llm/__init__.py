"""Operators for large text and record collections. Nothing outside this package imports it."""
