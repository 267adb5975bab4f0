"""Operators that prepare text and vectors for training language models.

Nothing outside this package imports it.  Each operator module keeps a
general interface; ``queries`` holds the thin registered queries.
"""
