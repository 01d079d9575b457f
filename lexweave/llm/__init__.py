"""Operators for preparing training text and media, one module each."""
