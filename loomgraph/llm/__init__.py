"""Operators on free text, vectors and corpora for training data."""
