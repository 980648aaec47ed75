"""Readers: from log files and databases to usage rows."""
