"""Compositions: configuration, pipelines, request-shaped functions and the registered queries."""
