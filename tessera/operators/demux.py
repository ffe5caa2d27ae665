"""Assigning reads to guides and samples, with up to one mismatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dna import trim_to_prefix, variants_within_one

UNKNOWN = "unknown"


def resolver(names: DataFrame, name: str, seq: str, alphabet: str = "ACGTN") -> DataFrame:
    """``seq, names``: every string within one mismatch of an expected sequence, and the names it may stand for.

    The dimension is expanded, so that reads are joined by equality: a
    dictionary of 1,500 sequences of 45 letters has 340,000 entries.
    """
    rows = names.select(F.col(name).alias("name"), F.explode(variants_within_one(F.upper(F.col(seq)), alphabet)).alias("seq"))
    return rows.groupBy("seq").agg(F.sort_array(F.collect_set("name")).alias("names"))


def assign(reads: DataFrame, read_seq: Column, names: DataFrame, column: str) -> DataFrame:
    """Adds the name if exactly one is within a mismatch of the read, else 'unknown'.

    Distinct read sequences are resolved once and joined back; the planner picks
    the join by size.
    """
    rows = reads.withColumn("_seq", F.upper(read_seq))
    found = rows.join(names.withColumnRenamed("seq", "_seq"), "_seq", "left")
    return found.withColumn(column, F.when(F.size("names") == 1, F.col("names")[0]).otherwise(UNKNOWN)).drop("_seq", "names")


def assign_by_two(reads: DataFrame, a: Column, b: Column, names_a: DataFrame, names_b: DataFrame, column: str) -> DataFrame:
    """The one name that both sequences may stand for, else 'unknown'; names both indices if there is none."""
    rows = reads.withColumn("_a", F.upper(a)).withColumn("_b", F.upper(b))
    rows = rows.join(names_a.select(F.col("seq").alias("_a"), F.col("names").alias("_na")), "_a", "left").join(names_b.select(F.col("seq").alias("_b"), F.col("names").alias("_nb")), "_b", "left")
    both = F.array_intersect(F.coalesce("_na", F.array().cast("array<string>")), F.coalesce("_nb", F.array().cast("array<string>")))
    return rows.withColumn("_both", both).withColumn(column, F.when(F.size("_both") == 1, F.col("_both")[0]).otherwise(UNKNOWN)).withColumn(f"{column}_key", F.when(F.size("_both") == 1, F.col("_both")[0]).otherwise(F.concat_ws("+", "_a", "_b"))).drop("_a", "_b", "_na", "_nb", "_both")


def key_counts(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of every key, unknown ones included."""
    return assigned.groupBy(*keys).agg(F.count("*").alias("n"))


def top_sequences(reads: DataFrame, seq: Column, names: DataFrame, expected: DataFrame, top: int = 100) -> DataFrame:
    """The most frequent sequences with their share of all reads and how they relate to the expected ones."""
    counts = reads.groupBy(F.upper(seq).alias("seq")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n")).first()[0] or 1
    best = counts.orderBy(F.desc("n"), "seq").limit(top)
    exact = expected.select(F.upper("seq").alias("seq")).distinct().withColumn("_exact", F.lit(True))
    rows = best.join(names, "seq", "left").join(exact, "seq", "left")
    kind = F.when(F.col("_exact"), "exact").when(F.size("names") == 1, "mismatch").when(F.size("names") > 1, "ambiguous").otherwise(UNKNOWN)
    return rows.select("seq", "n", (F.col("n") / F.lit(whole)).alias("fraction"), kind.alias("kind"), F.array_join("names", ";").alias("names"))


def library_composition(reads: DataFrame, seq: Column, prefix: str, guides: DataFrame, guide_seq: str, length: int) -> DataFrame:
    """Exact counts per guide after trimming to a prefix near the start; 0 for a guide that no read has."""
    start = F.substring(trim_to_prefix(F.upper(seq), prefix), 1, length)
    counts = reads.groupBy(start.alias("_s")).agg(F.count("*").alias("n"))
    wanted = guides.select("guide", F.substring(F.upper(F.col(guide_seq)), 1, length).alias("_s"))
    return wanted.join(counts, "_s", "left").select("guide", F.coalesce("n", F.lit(0)).alias("n"))


def quality_split(reads: DataFrame, share: Column, least: float = 0.6) -> DataFrame:
    """Adds ``passes``: the share is above ``least``; false for a null share."""
    return reads.withColumn("passes", F.coalesce(share > least, F.lit(False)))


def work_order(counts: DataFrame, key: str) -> DataFrame:
    """Keys by falling number of reads, unknown ones left out."""
    return counts.filter(F.col(key) != UNKNOWN).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), key)))
