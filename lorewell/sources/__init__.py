"""Lorewell sources."""
