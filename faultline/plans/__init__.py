"""Whole jobs composed of operators, one lazy plan each."""
