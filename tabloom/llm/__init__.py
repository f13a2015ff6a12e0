"""Operators of a training-data pipeline on text tables."""
