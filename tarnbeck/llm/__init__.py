"""Operators for language-model corpora. Nothing outside this package imports it."""
