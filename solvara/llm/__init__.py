"""Operators for preparing training data for language models.

Each module holds one operator as a ``DataFrame -> DataFrame`` function.  Nothing outside
this subpackage imports it, so it can be removed as a whole.
"""
