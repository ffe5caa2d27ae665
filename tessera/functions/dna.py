"""Column functions on sequences, barcodes and quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Other letters than A, C, G, T stay as they are; null for null."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def letters(seq: Column) -> Column:
    return F.split(seq, "")


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of one length; null if the lengths differ."""
    differ = F.zip_with(letters(a), letters(b), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(F.aggregate(differ, F.lit(0), lambda s, x: s + x)))


def phred(qual: Column) -> Column:
    """Scores of a quality string with offset 33."""
    return F.when(F.length(qual) > 0, F.transform(letters(qual), lambda c: F.ascii(c) - 33)).when(qual.isNotNull(), F.array().cast("array<int>"))


def phred_string(scores: Column) -> Column:
    return F.array_join(F.transform(scores, lambda x: F.chr((x + 33).cast("long"))), "")


def quality_hamming(a: Column, b: Column, qual_a: Column, qual_b: Column, least: int) -> Column:
    """Differing places at which both qualities reach ``least``."""
    places = F.arrays_zip(letters(a).alias("a"), letters(b).alias("b"), phred(qual_a).alias("x"), phred(qual_b).alias("y"))
    return F.size(F.filter(places, lambda p: (p["a"] != p["b"]) & (p["x"] >= least) & (p["y"] >= least)))


def seed_mismatches(seed: Column, seq: Column, qual: Column, least: int) -> Column:
    """Places of ``seq`` that differ from ``seed`` with quality of at least ``least``."""
    places = F.arrays_zip(letters(seq).alias("a"), letters(F.substring(seed, F.lit(1), F.length(seq))).alias("b"), phred(qual).alias("x"))
    return F.size(F.filter(places, lambda p: p["b"].isNotNull() & (p["a"] != p["b"]) & (p["x"] >= least)))


def mismatch_positions(seq: Column, expected: Column, qual: Column | None = None, least: int = 0) -> Column:
    """0-based places where ``seq`` differs from ``expected``, with quality of at least ``least`` if one is given."""
    length = F.least(F.length(seq), F.length(expected))
    at = F.sequence(F.lit(0), length - 1)
    test = lambda i: F.substring(seq, i + 1, F.lit(1)) != F.substring(expected, i + 1, F.lit(1))
    if qual is None:
        keep = test
    else:
        keep = lambda i: test(i) & ((F.ascii(F.substring(qual, i + 1, F.lit(1))) - 33) >= least)
    return F.when(length > 0, F.filter(at, keep)).otherwise(F.array().cast("array<int>"))


def classify_guide(seq: Column, expected: Column, qual: Column, least: int = 30) -> Column:
    """-1 for a perfect guide or none with a sure mismatch, the place of the only sure mismatch, null for more than one."""
    at = mismatch_positions(seq, expected, qual, least)
    return F.when(seq == expected, F.lit(-1)).when(F.size(at) == 0, F.lit(-1)).when(F.size(at) == 1, at[0])


def count_letter(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letter, ""))


def longest_run(seq: Column, letter: str) -> Column:
    """Length of the longest run of ``letter``; 0 for none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(seq, F.lit(f"{letter}+"), 0), lambda x: F.length(x))), F.when(seq.isNotNull(), F.lit(0)))


def quality_fraction(qual: Column, least: int = 30, second_half: bool = False) -> Column:
    """Share of scores of at least ``least``, over all or the second half; null for an empty string."""
    part = F.substring(qual, F.floor(F.length(qual) / 2).cast("int") + 1, F.length(qual)) if second_half else qual
    low = "".join(chr(c) for c in range(33, 33 + least))
    return F.when(F.length(part) > 0, F.length(F.translate(part, low, "")) / F.length(part))


def variants_within_one(seq: Column, alphabet: str = "ACGTN") -> Column:
    """All strings that differ from ``seq`` in at most one place, as an array without repeats."""
    at = F.sequence(F.lit(1), F.length(seq))
    changed = F.flatten(F.transform(at, lambda i: F.transform(F.array(*[F.lit(c) for c in alphabet]), lambda c: F.concat(F.substring(seq, F.lit(1), i - 1), c, F.substring(seq, i + 1, F.length(seq))))))
    return F.array_distinct(F.concat(F.array(seq), changed))


def trim_to_prefix(seq: Column, prefix: str, within: int = 10) -> Column:
    """``seq`` from ``prefix`` on, if that starts within the first ``within`` letters; else the whole."""
    at = F.locate(prefix, F.substring(seq, 1, within + len(prefix) - 1))
    return F.when(at > 0, F.substring(seq, at, F.length(seq))).otherwise(seq)
