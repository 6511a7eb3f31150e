"""Operators over text corpora and vectors; nothing else in the library imports them."""
