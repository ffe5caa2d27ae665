"""Correlation and similarity of guides and outcomes over a common axis."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items of a block; two blocks with their values are what a task holds.
BLOCK_ITEMS = 256


def pearson(x: str, y: str) -> Column:
    """Pearson r as an aggregate; null where one side is constant."""
    ok = (F.stddev_samp(x) > 0) & (F.stddev_samp(y) > 0)
    sxy = F.count("*") * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)
    sxx = F.count("*") * F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x)
    syy = F.count("*") * F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y)
    return F.when(ok & (sxx > 0) & (syy > 0), sxy / F.sqrt(F.when((sxx > 0) & (syy > 0), sxx * syy).otherwise(F.lit(1.0))))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray, centred: bool) -> np.ndarray:
    """Rows at length 1, those without a length NaN; a constant row has none once it is centred."""
    y = x - x.mean(1, keepdims=True) if centred else x
    length = np.sqrt((y * y).sum(1, keepdims=True))
    none = (length == 0) | ((x.max(1, keepdims=True) == x.min(1, keepdims=True)) if centred else False)
    return np.where(none, np.nan, y / np.where(length > 0, length, 1))


def _pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _unit(x, True) @ _unit(y, True).T


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _unit(x, False) @ _unit(y, False).T


def _closeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([1 / (1 + np.sqrt(((y - row) ** 2).sum(1))) for row in x])


def block_pairs(df: DataFrame, item: str, axis: list[str], value: str, measures: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]], block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``a, b`` and the measures of all pairs a < b of items.

    Every item has a value at every place of the axis.  Items are spread over
    blocks, and every pair of blocks is one matrix product in one task, so the
    exchange grows with items times blocks, not with pairs times places.
    Measures are null where a side is constant or has no length.
    """
    rows = df.groupBy(F.col(item).alias("item")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(axis)], F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("vec"))
    n = max(1, -(-df.select(item).distinct().count() // block_items))
    own = F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tile = (F.least("own", "other") * F.lit(n) + F.greatest("own", "other")).alias("tile")
    spread = spread.select(tile, (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "item", "vec")
    names = list(measures)

    def work(table: pa.Table) -> pa.Table:
        left, right = table.filter(table["left"]), table.filter(table["right"])
        ids = [np.array(t["item"].to_pylist(), object) for t in (left, right)]
        diagonal = table["left"].to_pylist() == table["right"].to_pylist() and len(left) == len(table)
        i, j = np.triu_indices(len(left), 1) if diagonal else (g.ravel() for g in np.indices((len(left), len(right))))
        swap = ids[0][i] > ids[1][j] if len(i) else np.zeros(0, bool)
        out = {"a": pa.array(np.where(swap, ids[1][j], ids[0][i]).tolist(), pa.string()), "b": pa.array(np.where(swap, ids[0][i], ids[1][j]).tolist(), pa.string())}
        x, y = (_matrix(t["vec"]) for t in (left, right))
        for name in names:
            found = measures[name](x, y)[i, j] if len(i) else np.zeros(0)
            out[name] = pa.array(found, pa.float64(), mask=~np.isfinite(found))
        return pa.table(out)

    return spread.groupBy("tile").applyInArrow(work, "a string, b string, " + ", ".join(f"{m} double" for m in names))


def correlations(df: DataFrame, item: str, axis: list[str], value: str) -> DataFrame:
    return block_pairs(df, item, axis, value, {"r": _pearson})


def similarities(df: DataFrame, item: str, axis: list[str], value: str) -> DataFrame:
    """Correlation, cosine, and 1 / (1 + euclidean distance) of every pair."""
    return block_pairs(df, item, axis, value, {"correlation": _pearson, "cosine": _cosine, "euclidean": _closeness})


def both_ways(pairs: DataFrame, value: str) -> DataFrame:
    """Every pair from both of its ends."""
    return pairs.select("a", "b", value).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value))


def best_gene_pairs(pairs: DataFrame, genes: DataFrame, value: str = "r") -> DataFrame:
    """The largest value of any two guides of every pair of genes."""
    g = genes.select("guide", "gene")
    rows = pairs.join(g.select(F.col("guide").alias("a"), F.col("gene").alias("ga")), "a").join(g.select(F.col("guide").alias("b"), F.col("gene").alias("gb")), "b")
    return rows.groupBy(F.least("ga", "gb").alias("gene_a"), F.greatest("ga", "gb").alias("gene_b")).agg(F.max(value).alias("highest"))


def replicate_correlations(df: DataFrame, item: str, axis: list[str], replicate: str, value: str) -> DataFrame:
    """Within the first replicate, within the second one, and of the same item between both: ``part, a, b, r``.

    ``replicate`` holds 0 and 1.
    """
    first, second = (correlations(df.filter(F.col(replicate) == i), item, axis, value).withColumn("part", F.lit(f"replicate_{i}")) for i in (0, 1))
    return first.unionByName(second).unionByName(item_replicate_r(df, item, axis, replicate, value).select(F.col(item).alias("a"), F.col(item).alias("b"), "r", F.lit("between").alias("part")))


def item_replicate_r(df: DataFrame, item: str, axis: list[str], replicate: str, value: str) -> DataFrame:
    """r between the two replicates of every item, over the axis."""
    wide = df.groupBy(item, *axis).agg(F.max(F.when(F.col(replicate) == 0, F.col(value))).alias("x"), F.max(F.when(F.col(replicate) == 1, F.col(value))).alias("y")).filter("x is not null and y is not null")
    return wide.groupBy(item).agg(pearson("x", "y").alias("r"))


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and densities in equal bins of [low, high]; the upper end falls into the last bin."""
    bin_ = F.least(F.floor((F.col(value) - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).between(low, high)).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    return counts.join(whole, by).select(*by, "bin", "n", (F.col("n") / (F.col("_all") * F.lit((high - low) / bins))).alias("density"))


def ranked_partners(pairs: DataFrame, value: str, top: int) -> DataFrame:
    """The ``top`` most and least similar partners of every item."""
    rows = both_ways(pairs.filter(F.col(value).isNotNull()), value)
    for name, order in (("rank_high", F.desc(value)), ("rank_low", F.asc(value))):
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy("a").orderBy(order, "b")))
    return rows.filter((F.col("rank_high") <= top) | (F.col("rank_low") <= top))
