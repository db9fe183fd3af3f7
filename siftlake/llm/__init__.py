"""Operators on text corpora for language-model training data. Nothing outside this package imports it."""
