"""Relational operators of the survey workflow, DataFrame in and DataFrame out."""
