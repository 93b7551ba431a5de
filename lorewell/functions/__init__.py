"""Lorewell functions."""
