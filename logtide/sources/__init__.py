"""Readers, sinks and the log lines derived from tables."""
