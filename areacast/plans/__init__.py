"""Whole jobs composed from the operators and models."""
