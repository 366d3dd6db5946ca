"""Operators for preparing training corpora.  Nothing outside this package imports it."""
