"""Operators of a training-data pipeline over text, page, vector and chat tables."""
