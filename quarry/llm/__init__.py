"""Operators for preparing training data. Nothing outside this sub-package imports it."""
