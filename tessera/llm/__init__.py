"""Operators for building training data from text, media and vectors. Nothing else in the library imports this."""
