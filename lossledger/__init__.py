"""Incident loss analytics expressed as PySpark DataFrame transformations."""
