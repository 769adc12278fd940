"""Tessella: analytics over (Ticker, Date) panels, written as Spark DataFrame transformations."""

__version__ = "0.1.0"
