"""The grammar of outcome details, and geometry on it.

Parts are joined by ``;``: ``D:start,length`` deletion, ``I:start,bases``
insertion, ``S:placebase`` base change, ``U:start,length`` duplication,
``G:place,length`` inserted foreign sequence, ``M:place`` misintegration;
``n/a`` for none and ``collapsed`` or any other text for what has no places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(details: Column, kind: str, group: int, pattern: str) -> Column:
    text = F.regexp_extract(details, rf"(?:^|;){kind}:{pattern}", group)
    return F.when(text != "", text)


def deletion_start(details: Column) -> Column:
    return part(details, "D", 1, r"(\d+),(\d+)").cast("int")


def deletion_length(details: Column) -> Column:
    return part(details, "D", 2, r"(\d+),(\d+)").cast("int")


def insertion_start(details: Column) -> Column:
    return part(details, "I", 1, r"(\d+),([ACGTN]+)").cast("int")


def inserted_bases(details: Column) -> Column:
    return part(details, "I", 2, r"(\d+),([ACGTN]+)")


def change_place(details: Column) -> Column:
    return part(details, "S", 1, r"(\d+)([ACGTN])").cast("int")


def change_base(details: Column) -> Column:
    return part(details, "S", 2, r"(\d+)([ACGTN])")


def duplication_start(details: Column) -> Column:
    return part(details, "U", 1, r"(\d+),(\d+)").cast("int")


def duplication_length(details: Column) -> Column:
    return part(details, "U", 2, r"(\d+),(\d+)").cast("int")


def foreign_place(details: Column) -> Column:
    return part(details, "G", 1, r"(\d+),(\d+)").cast("int")


def foreign_length(details: Column) -> Column:
    return part(details, "G", 2, r"(\d+),(\d+)").cast("int")


def misintegration_place(details: Column) -> Column:
    return part(details, "M", 1, r"(\d+)").cast("int")


def format_deletion(start: Column, length: Column) -> Column:
    return F.format_string("D:%d,%d", start, length)


def format_insertion(start: Column, bases: Column) -> Column:
    return F.format_string("I:%d,%s", start, bases)


def shift(place: Column, anchor: int) -> Column:
    """Places relative to an anchor; undone by the negative anchor."""
    return place - F.lit(anchor)


def flip(place: Column, length: Column, cut: int) -> Column:
    """Start of a stretch as seen from the other strand, mirrored at the cut between ``cut`` and ``cut + 1``."""
    return F.lit(2 * cut + 1) - (place + length - 1)


def removed_left(start: Column, length: Column, cut: int) -> Column:
    """Bases that a deletion takes at or before ``cut``."""
    return F.greatest(F.lit(0), F.least(start + length - 1, F.lit(cut)) - start + 1)


def removed_right(start: Column, length: Column, cut: int) -> Column:
    """Bases that a deletion takes after ``cut``."""
    return F.greatest(F.lit(0), start + length - 1 - F.greatest(start - 1, F.lit(cut)))


def directionality(start: Column, length: Column, cut: int) -> Column:
    left, right = removed_left(start, length, cut), removed_right(start, length, cut)
    return F.when((left > 0) & (right > 0), "bidirectional").when(left > 0, "left").when(right > 0, "right")


def base_complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")
