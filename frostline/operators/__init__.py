"""Operators: plain functions from tables (and an explicit ``as_of``) to a DataFrame."""
