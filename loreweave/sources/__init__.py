"""Readers and writers for vault folders, logs, exports and benchmark files."""
