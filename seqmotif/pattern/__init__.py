"""The motif language: one syntax tree for scanning, checking and explaining."""

from seqmotif.pattern.parser import Pattern, PatternError, parse
from seqmotif.pattern.units import Unit

__all__ = ["Pattern", "PatternError", "Unit", "parse"]
