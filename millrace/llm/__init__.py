"""Operators for preparing language-model training data."""
