"""Operators for preparing training data.

Everything in this subpackage stands alone: the rest of the library never
imports it, and its queries are registered only when it can be imported.
"""
