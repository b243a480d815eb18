"""Readers, positional scans and table sinks."""
