"""Whole reports composed from the operators into one lazy plan."""
