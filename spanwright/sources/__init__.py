"""Readers of recorded files, and writers."""
