"""Scans, domain views over the test tables, and sinks."""
