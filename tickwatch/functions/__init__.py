"""Column functions and the small per-batch numeric helpers."""
