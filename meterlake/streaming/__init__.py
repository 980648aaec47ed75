"""Streams of usage rows."""
