"""Lorewell streaming."""
