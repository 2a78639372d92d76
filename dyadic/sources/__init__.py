"""Scans, sinks and parameter tables."""
