"""Operators for the preparation of training data."""
