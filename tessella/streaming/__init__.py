"""Panels from streams."""
