"""Readers and writers of change records, listings and diffs. Paths are read by Spark alone."""
