"""Filters and validation on streams."""
