"""Scans, sinks and replayable providers."""
