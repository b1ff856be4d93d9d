"""Operators for cleaning and preparing language-model training text. Nothing else in the library imports this."""
