"""Training-data operators over the ``documents``-like tables.

Nothing outside this package imports it, so it can be removed as a whole.
"""
