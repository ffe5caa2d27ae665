"""Single cells: which guide a cell has, mixtures of its counts, and resampled expression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_metrics(counts: DataFrame, cell: str = "cell", feature: str = "feature", n: str = "n") -> DataFrame:
    """Per cell the total, the largest feature, its name (ties by name) and its share."""
    best = F.max(F.struct(F.col(n).alias("n"), F.col(feature).alias("f")))
    rows = counts.groupBy(cell).agg(F.sum(n).alias("total"), best.alias("_b"))
    return rows.select(cell, "total", F.col("_b.n").alias("highest"), F.col("_b.f").alias("highest_feature"), F.when(F.col("total") > 0, F.col("_b.n") / F.col("total")).alias("share_highest"))


def aligned_cells(cells: DataFrame, guides: DataFrame, cell: str = "cell") -> DataFrame:
    """Cells with their guide metrics; -1, 0 and 'none' where a cell has none."""
    out = cells.join(guides, cell, "left")
    return out.withColumns({"highest": F.coalesce("highest", F.lit(0)), "total": F.coalesce("total", F.lit(0)), "share_highest": F.coalesce("share_highest", F.lit(-1.0)), "highest_feature": F.coalesce("highest_feature", F.lit("none"))})


def with_lane(lanes: dict[str, DataFrame], cell: str = "cell") -> DataFrame:
    """Lanes below each other, the lane added to the cell name."""
    out = None
    for lane, df in lanes.items():
        rows = df.withColumn(cell, F.concat_ws("-", F.col(cell).cast("string"), F.lit(lane)))
        out = rows if out is None else out.unionByName(rows)
    return out


def _quantile(x: np.ndarray, cells: np.ndarray, q: float) -> float:
    """The quantile of ascending values that occur ``cells`` times each, interpolated as by numpy."""
    at = q * (int(cells.sum()) - 1)
    low, high = x[np.searchsorted(cells.cumsum(), [math.floor(at), math.ceil(at)], side="right")]
    return float(low + (high - low) * (at - math.floor(at)))


def fit_two(x: np.ndarray, cells: np.ndarray, rounds: int = 100) -> tuple[float, float, float, float]:
    """Weight of the upper part, Poisson rate of the lower one, mean and deviation of the upper one, on log2(count + 1).

    ``x`` are the distinct values, ascending, and ``cells`` how many cells have each.
    """
    whole = float(cells.sum())
    sd = math.sqrt(float((cells * (x - (cells * x).sum() / whole) ** 2).sum() / whole))
    rate, mean, sd, w = max(1e-3, _quantile(x, cells, 0.25)), float(x.max()), max(0.3, sd), 0.5
    lg = np.array([math.lgamma(v + 1) for v in x])
    for _ in range(rounds):
        low = np.log(max(1e-12, 1 - w)) + x * math.log(max(rate, 1e-9)) - rate - lg
        high = np.log(max(1e-12, w)) - 0.5 * ((x - mean) / sd) ** 2 - math.log(sd * math.sqrt(2 * math.pi))
        r = 1 / (1 + np.exp(np.clip(low - high, -500, 500)))
        upper, lower = cells * r, cells * (1 - r)
        if upper.sum() < 1e-9 or lower.sum() < 1e-9:
            break
        w, mean = float(upper.sum() / whole), float((upper * x).sum() / upper.sum())
        sd = max(0.1, math.sqrt(float((upper * (x - mean) ** 2).sum() / upper.sum())))
        rate = float((lower * x).sum() / lower.sum())
    return w, rate, mean, sd


def mixture_calls(counts: DataFrame, cell: str = "cell", feature: str = "feature", n: str = "n") -> DataFrame:
    """``feature, cell, n, is_called, threshold``: cells above the lower part of a mixture of a Poisson and a normal part.

    The fit needs the histogram of a feature only, its cells as weights: the
    counts are binned before they are grouped, so a feature of any number of
    cells is a small group.
    """
    binned = counts.groupBy(feature, n).agg(F.count("*").alias("cells"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(n)
        grid = np.log2(rows[n].to_numpy(float) + 1)
        w, rate, mean, sd = fit_two(grid, rows["cells"].to_numpy())
        low = np.array([(1 - w) * math.exp(v * math.log(max(rate, 1e-9)) - rate - math.lgamma(v + 1)) for v in grid])
        high = w * np.exp(-0.5 * ((grid - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))
        above = grid[(high > low) & (grid > rate)]
        return pd.DataFrame({feature: [rows[feature].iloc[0]], "threshold": [float(2 ** above[0] - 1) if len(above) else float("inf")]})

    limits = binned.groupBy(feature).applyInPandas(work, f"{feature} string, threshold double")
    return counts.join(limits, feature).withColumn("is_called", F.col(n) >= F.col("threshold"))


def guide_calls(called: DataFrame, cell: str = "cell", feature: str = "feature", n: str = "n") -> DataFrame:
    """Per cell the called feature with the largest count and how many are called."""
    best = F.max(F.when(F.col("is_called"), F.struct(F.col(n).alias("n"), F.col(feature).alias("f"))))
    return called.groupBy(cell).agg(best["f"].alias("call"), F.sum(F.col("is_called").cast("int")).alias("n_called"))


def bootstrap_fractions(cells: DataFrame, guide: str, numerator: str, denominator: str, replicates: int = 100, seed: int = 1) -> DataFrame:
    """``guide, replicate, fraction``: resampled share of the sums; replicate 0 is the data as they are.

    Every cell gets a Poisson weight from a hash of its row and the replicate,
    so resampling is an aggregate with partial sums.
    """
    rows = cells.select(F.col(guide).alias("guide"), F.col(numerator).alias("a"), F.col(denominator).alias("b"), F.xxhash64(*cells.columns).alias("h"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            weight = np.ones((len(part), replicates + 1))
            if len(part):
                for i, h in enumerate(part["h"].to_numpy().astype(np.uint64)):
                    weight[i, 1:] = np.random.default_rng([seed, int(h)]).poisson(1.0, replicates)
            for g, at in part.groupby("guide").indices.items():
                a, b = part["a"].to_numpy(float)[at] @ weight[at], part["b"].to_numpy(float)[at] @ weight[at]
                yield pd.DataFrame({"guide": g, "replicate": np.arange(replicates + 1), "a": a, "b": b})

    sums = rows.mapInPandas(work, "guide string, replicate int, a double, b double").groupBy("guide", "replicate").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select("guide", "replicate", F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("fraction"))


def knockdown(fractions: DataFrame, controls: str, quantiles: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Fraction of every guide against the controls, with quantiles of the resampled ratio."""
    base = fractions.filter(F.col("guide") == controls).select("replicate", F.col("fraction").alias("base"))
    ratio = fractions.join(base, "replicate").withColumn("ratio", F.when(F.col("base") > 0, F.col("fraction") / F.col("base")))
    return ratio.groupBy("guide").agg(F.max(F.when(F.col("replicate") == 0, F.col("ratio"))).alias("remaining"), *[F.percentile(F.when(F.col("replicate") > 0, F.col("ratio")), F.lit(q)).alias(name) for q, name in zip(quantiles, ("low", "high"))])


def example_rows(df: DataFrame, by: list[str], n: int, seed: int = 1) -> DataFrame:
    """``n`` rows of every group, chosen by a seeded hash of the row: a fixed sample for pictures."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns))).filter(F.col("_r") <= n).drop("_r")
