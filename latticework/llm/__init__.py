"""Operators for training-data preparation; nothing outside imports them."""
