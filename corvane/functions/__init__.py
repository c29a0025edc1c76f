"""Subpackage of corvane."""
