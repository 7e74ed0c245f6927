"""Operators of the engine: scanning, chaining, naming, merging."""
