"""Patterns, dictionaries, formats and thresholds the operators apply."""
