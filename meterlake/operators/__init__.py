"""Operators over usage rows: each takes and returns DataFrames."""
