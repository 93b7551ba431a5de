"""Lorewell operators."""
