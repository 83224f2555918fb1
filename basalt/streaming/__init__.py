"""Streams over logs."""
