"""Choosing and building the physical strategy of a scan."""
