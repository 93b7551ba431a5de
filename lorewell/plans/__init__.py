"""Lorewell plans."""
