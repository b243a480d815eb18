"""Operators bound to the shared test tables."""
