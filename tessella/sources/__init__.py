"""Readers, writers and the schemas of panels."""
