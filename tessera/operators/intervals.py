"""Positions, lengths and coverage along the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import outcomes as O
from tessera.functions.ratios import log2_or_null, safe_ratio

MAX_LENGTH, UNKNOWN_LENGTH = 1000, 1050


def coverage(df: DataFrame, by: list[str], start: str, stop: str, weight: str) -> DataFrame:
    """``*by, position, covered, starts, stops`` at every position where something changes.

    Weights over [start, stop] are added as differences and summed along the
    positions, so a long interval costs two rows.
    """
    up = df.select(*by, F.col(start).alias("position"), F.col(weight).alias("d"), F.col(weight).alias("s"), (F.col(weight) * 0).alias("e"))
    down = df.select(*by, (F.col(stop) + 1).alias("position"), (-F.col(weight)).alias("d"), (F.col(weight) * 0).alias("s"), (F.col(weight) * 0).alias("e"))
    ends = df.select(*by, F.col(stop).alias("position"), (F.col(weight) * 0).alias("d"), (F.col(weight) * 0).alias("s"), F.col(weight).alias("e"))
    changes = up.unionByName(down).unionByName(ends).groupBy(*by, "position").agg(F.sum("d").alias("d"), F.sum("s").alias("starts"), F.sum("e").alias("stops"))
    w = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("covered", F.sum("d").over(w)).drop("d")


def dense_coverage(df: DataFrame, by: list[str], start: str, stop: str, weight: str, low: int, high: int, labels: DataFrame) -> DataFrame:
    """Coverage at every position of [low, high] for every label, zeros included."""
    clipped = df.withColumn("_s", F.greatest(F.col(start), F.lit(low))).withColumn("_e", F.least(F.col(stop), F.lit(high))).filter("_s <= _e")
    per = clipped.select(*by, F.explode(F.sequence("_s", "_e")).alias("position"), F.col(weight).alias("_w")).groupBy(*by, "position").agg(F.sum("_w").alias("covered"))
    grid = labels.select(*by).withColumn("position", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return grid.join(per, [*by, "position"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def deletion_intervals(counts: DataFrame) -> DataFrame:
    """Rows with a deletion, with its first and last removed position."""
    rows = counts.withColumn("start", O.deletion_start(F.col("details"))).withColumn("length", O.deletion_length(F.col("details")))
    return rows.filter("start is not null and length > 0").withColumn("stop", F.col("start") + F.col("length") - 1)


def edges(intervals: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Counts of interval starts and ends per position."""
    rows = intervals.select(*by, F.explode(F.array(F.struct(F.lit("start").alias("edge"), F.col("start").alias("position")), F.struct(F.lit("end").alias("edge"), F.col("stop").alias("position")))).alias("x"), F.col(weight).alias("_w"))
    return rows.select(*by, "x.edge", "x.position", "_w").groupBy(*by, "edge", "position").agg(F.sum("_w").alias("n"))


def overlaps(intervals: DataFrame, features: DataFrame) -> DataFrame:
    """Intervals with every feature (``feature, f_start, f_stop``) that they touch, and whether they lie inside it.

    Features are few: those of one target.
    """
    joined = intervals.join(F.broadcast(features.limit(10_000)) if features.limit(10_001).count() <= 10_000 else features, (F.col("start") <= F.col("f_stop")) & (F.col("stop") >= F.col("f_start")))
    return joined.withColumn("inside", (F.col("start") >= F.col("f_start")) & (F.col("stop") <= F.col("f_stop")))


def capped_length(length: Column, most: int = MAX_LENGTH, unknown: int = UNKNOWN_LENGTH) -> Column:
    """Lengths of at most ``most``; -1 and null go to the bucket of unknown ones."""
    return F.when(length.isNull() | (length < 0), F.lit(unknown)).otherwise(F.least(length, F.lit(most)))


def dense_histogram(df: DataFrame, by: list[str], value: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``*by, value, n`` for all integers from the least to the largest value (or the given ends), zeros included; null values are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(*by).agg((F.min("value") if low is None else F.lit(low)).alias("_a"), (F.max("value") if high is None else F.lit(high)).alias("_b"))
    grid = ends.select(*by, F.explode(F.sequence("_a", "_b")).alias("value"))
    return grid.join(counts, [*by, "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def smoothed(df: DataFrame, by: list[str], order: str, value: str, reach: int = 10) -> DataFrame:
    """Centred moving mean over ``2 * reach + 1`` rows, fewer at the ends."""
    return df.withColumn("smooth", F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)))


def deletion_grid(intervals: DataFrame, by: list[str], cut: int, reach: int, weight: str, labels: DataFrame) -> DataFrame:
    """Weights by the bases removed left and right of the cut, every cell within ``reach``, zeros included."""
    rows = intervals.withColumn("left", O.removed_left(F.col("start"), F.col("length"), cut)).withColumn("right", O.removed_right(F.col("start"), F.col("length"), cut)).filter(F.col("left").between(0, reach) & F.col("right").between(0, reach))
    cells = rows.groupBy(*by, "left", "right").agg(F.sum(weight).alias("n"))
    grid = labels.select(*by).withColumn("left", F.explode(F.sequence(F.lit(0), F.lit(reach)))).withColumn("right", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    return grid.join(cells, [*by, "left", "right"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mismatch_rates(changes: DataFrame, by: list[str], totals: DataFrame, anchor: int, low: int, high: int, labels: DataFrame) -> DataFrame:
    """Rate of every base at every offset from the anchor, zeros included.

    ``changes`` has ``place, base, n``; ``totals`` has ``total`` per label.
    """
    rates = changes.withColumn("offset", F.col("place") - anchor).groupBy(*by, "offset", "base").agg(F.sum("n").alias("n"))
    grid = labels.select(*by).withColumn("offset", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("base", F.explode(F.array(*[F.lit(b) for b in "TCAG"])))
    rows = grid.join(rates, [*by, "offset", "base"], "left").join(totals, by, "left")
    return rows.withColumn("rate", safe_ratio(F.coalesce("n", F.lit(0)), F.col("total"))).select(*by, "offset", "base", "rate")


def log2_against(df: DataFrame, value: str, base: str) -> Column:
    return log2_or_null(safe_ratio(F.col(value), F.col(base)))


def length_buckets(df: DataFrame, length: str, buckets: DataFrame) -> DataFrame:
    """Adds the bucket (``bucket, low, high``) that holds the length, by an equality join on the exploded bucket."""
    wide = buckets.select("bucket", F.explode(F.sequence("low", "high")).alias(length))
    return df.join(wide, length, "left")


def covered_length(starts_stops: Column) -> Column:
    """Bases covered by an array of structs (start, stop), overlaps once."""
    ordered = F.array_sort(starts_stops)
    zero = F.struct(F.lit(-(2**30)).alias("last"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["last"] + 1) + 1)
        return F.struct(F.greatest(acc["last"], x["stop"]).alias("last"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(ordered, zero, step, lambda acc: acc["n"])
