"""Operators for training data made from text. Nothing outside this package imports it."""
