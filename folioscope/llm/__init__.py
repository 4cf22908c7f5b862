"""Operators that prepare training data: filters, duplicates, extraction, mixing and packing."""
