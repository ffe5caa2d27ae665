"""Folding of names and sequences before comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_name(col: Column | str) -> Column:
    """Guide and quartet names: letter case and outer blanks do not count."""
    return F.upper(F.trim(F.col(col) if isinstance(col, str) else col))


def fold_dna(col: Column | str) -> Column:
    """DNA: letter case does not count."""
    return F.upper(F.col(col) if isinstance(col, str) else col)
