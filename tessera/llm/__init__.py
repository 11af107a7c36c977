"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it; deleting it leaves the rest of
the library untouched.
"""
