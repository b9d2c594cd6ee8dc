"""Scans, lookups, sinks and the views over the supplied tables."""
