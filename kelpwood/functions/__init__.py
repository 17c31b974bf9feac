"""Column functions and Python-worker helpers."""
