"""Corvane: opportunity-board analytics as Spark DataFrame transformations."""
