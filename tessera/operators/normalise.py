"""Fractions and fold changes against non-targeting controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ratios import log2_fold_change, safe_ratio
from tessera.operators.counts import ALL_NON_TARGETING, OUTCOME, densify, pooled_controls, share_of_total, totals

NOT_RELEVANT = ("uncategorized", "malformed layout", "bad sequence")


def dense_fractions(counts: DataFrame, guides: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts and fractions of the selected outcomes for every guide, zeros included.

    A fraction is the share of all records of the guide; null for a guide
    without records.
    """
    whole = totals(counts, ["guide"])
    dense = densify(guides, outcomes.select(*OUTCOME), counts.select("guide", *OUTCOME, "n"), ["guide", *OUTCOME], {"n": 0})
    return dense.join(whole, "guide", "left").withColumn("fraction", safe_ratio(F.col("n"), F.col("total")))


def baseline(counts: DataFrame) -> DataFrame:
    """``*OUTCOME, nt_n, nt_fraction`` pooled over all controls: a ratio of sums."""
    return share_of_total(pooled_controls(counts), "nt_n", "nt_fraction")


def outcome_fractions(counts: DataFrame) -> DataFrame:
    """Fractions per guide and of all controls together."""
    own = counts.groupBy("guide", *OUTCOME).agg(F.sum("n").alias("n"))
    controls = pooled_controls(counts).select(F.lit(ALL_NON_TARGETING).alias("guide"), *OUTCOME, F.col("nt_n").alias("n"))
    return share_of_total(own.unionByName(controls), "n", "fraction", ["guide"])


def log2_fold_changes(counts: DataFrame, guides: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Dense log2 fold changes of ``outcomes`` against the pooled controls."""
    dense = dense_fractions(counts, guides, outcomes)
    base = baseline(counts)
    joined = dense.join(base, OUTCOME, "left").withColumn("nt_fraction", F.coalesce("nt_fraction", F.lit(0.0)))
    return joined.withColumn("log2_fc", log2_fold_change(F.col("fraction"), F.col("nt_fraction")))


def outcome_set_fold_change(counts: DataFrame, guides: DataFrame, chosen: Column) -> DataFrame:
    """Fold change of a set of outcomes: summed first, then compared."""
    per = counts.groupBy("guide", "is_nt").agg(F.sum(F.when(chosen, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("total"))
    nt = per.filter("is_nt").agg(F.sum("n"), F.sum("total")).first()
    base = float(nt[0]) / float(nt[1]) if nt and nt[1] else None
    out = guides.join(per.select("guide", "n", "total"), "guide", "left")
    return out.withColumn("fraction", safe_ratio(F.coalesce("n", F.lit(0)), F.col("total"))).withColumn("log2_fc", log2_fold_change(F.col("fraction"), F.lit(base).cast("double")))


def grouped_categories(counts: DataFrame, kept: list[str], not_relevant: tuple[str, ...] = NOT_RELEVANT) -> DataFrame:
    """Fractions of the kept categories; the rest is 'all others', what is not relevant is left out before."""
    rows = counts.filter(~F.col("category").isin(*not_relevant)).withColumn("category", F.when(F.col("category").isin(*kept), F.col("category")).otherwise("all others"))
    return share_of_total(rows.groupBy("guide", "category").agg(F.sum("n").alias("n")), "n", "fraction", ["guide"])


def expected_in_quantile(totals_: DataFrame, n: float = 15, q: float = 0.25) -> float:
    """Least fraction of an outcome of which ``n`` records are expected in a guide at quantile ``q`` of the sizes."""
    size = totals_.agg(F.percentile("total", F.lit(q))).first()[0]
    return n / size if size else float("inf")
