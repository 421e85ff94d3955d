"""Readers and writers for topic, judgment, run, learning and corpus files."""
