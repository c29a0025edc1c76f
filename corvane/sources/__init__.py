"""Readers of the input tables."""
from corvane.sources.tables import table

__all__ = ["table"]
