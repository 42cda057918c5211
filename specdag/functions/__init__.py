"""Expressions, calendars, names and profiles."""
