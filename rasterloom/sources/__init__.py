"""Scans, sinks and codecs."""
