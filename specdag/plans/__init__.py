"""Specifications, plans, and their checks."""
