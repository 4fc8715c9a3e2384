"""Operators for preparing training text: duplicates, leaks, scores, packing, archives and token files."""
