"""Lorewell: a PySpark-native engine over multi-platform conversation archives."""

__version__ = "0.1.0"
