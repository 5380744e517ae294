"""Operators for preparing training data: quality, duplicates, leaks, licences, mixing, sharding."""
