"""Named queries over usage rows, and the same queries in SQL."""
