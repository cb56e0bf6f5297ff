"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with a general DataFrame interface;
``queries`` holds the thin registered queries that derive digest columns from the operators' outputs.
"""
