"""Statistics of guides and genes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ratios import clamp, clamped_log2, safe_ratio
from tessera.functions.special import beta_binomial_tails, binomial_at_least_udf, binomial_cdf_udf, clopper_pearson_udf, fit_beta_binomial
from tessera.operators.counts import OUTCOME, densify


def numerator_and_denominator(counts: DataFrame, numerator: Column, denominator: Column | None = None) -> DataFrame:
    """``guide, numerator, denominator``: records of the chosen outcomes and of all (or the other chosen) ones."""
    return counts.groupBy("guide").agg(F.sum(F.when(numerator, F.col("n")).otherwise(0)).alias("numerator"), (F.sum("n") if denominator is None else F.sum(F.when(denominator, F.col("n")).otherwise(0))).alias("denominator"))


def guide_statistics(parts: DataFrame, guides: DataFrame) -> DataFrame:
    """Frequency and log2 fold change, drawn into [-5, 5], of every guide.

    The baseline is the ratio of the sums over all controls.  A guide without
    denominator has null statistics.
    """
    rows = guides.join(parts, "guide", "left").withColumns({"numerator": F.coalesce("numerator", F.lit(0)), "denominator": F.coalesce("denominator", F.lit(0))})
    nt = rows.filter("is_nt").agg(F.sum("numerator"), F.sum("denominator")).first()
    base = F.lit(float(nt[0]) / float(nt[1]) if nt and nt[1] else None).cast("double")
    out = rows.withColumn("frequency", safe_ratio(F.col("numerator"), F.col("denominator"))).withColumn("nt_fraction", base)
    return out.withColumn("log2_fc", clamped_log2(F.col("frequency"), F.col("nt_fraction")))


def gene_statistics(guides: DataFrame, value: str = "log2_fc", by: list[str] | None = None, best_only: bool = True, depth: int = 3) -> DataFrame:
    """Per gene the mean of the 1, 2, 3 lowest, highest and most extreme guides.

    A gene with fewer guides averages all it has.  Guides with a null value do
    not count; ties go by guide name.
    """
    keys = [*(by or []), "gene"]
    rows = guides.filter(F.col(value).isNotNull())
    if best_only:
        rows = rows.filter("is_best_promoter")
    order = {"lowest": F.asc(value), "highest": F.desc(value), "extreme": F.abs(F.col(value)).desc()}
    rows = rows.withColumns({f"_{k}": F.row_number().over(Window.partitionBy(*keys).orderBy(o, "guide")) for k, o in order.items()})
    return rows.groupBy(*keys).agg(*[F.avg(F.when(F.col(f"_{k}") <= n, F.col(value))).alias(f"{k}_{n}") for k in order for n in range(1, depth + 1)])


def gene_fold_changes(guides: DataFrame, value: str = "log2_fc", n: int = 2) -> DataFrame:
    """Mean of the ``n`` largest (up) and smallest (down) guides of every gene."""
    rows = guides.filter(F.col(value).isNotNull())
    for name, order in (("_up", F.desc(value)), ("_down", F.asc(value))):
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy("gene").orderBy(order, "guide")))
    return rows.groupBy("gene").agg(F.avg(F.when(F.col("_up") <= n, F.col(value))).alias("up_fc"), F.avg(F.when(F.col("_down") <= n, F.col(value))).alias("down_fc"), F.count("*").alias("n_guides"))


def chi_squared(counts: DataFrame, guides: DataFrame, outcomes: DataFrame, excluded: tuple[tuple[str, str, str], ...] = (("wild type", "clean", "n/a"),)) -> DataFrame:
    """``guide, chi_squared`` over the selected outcomes.

    Expected counts are the share of the controls times the total of the guide,
    both within the selected outcomes.  Guides without any of them are left
    out.  An expected 0 adds 0 where nothing is observed, else infinity.
    """
    kept = outcomes.select(*OUTCOME)
    for c, s, d in excluded:
        kept = kept.filter(~((F.col("category") == c) & (F.col("subcategory") == s) & (F.col("details") == d)))
    dense = densify(guides.select("guide", "is_nt"), kept, counts.select("guide", *OUTCOME, "n"), ["guide", *OUTCOME], {"n": 0})
    own = dense.groupBy("guide").agg(F.sum("n").alias("total")).filter("total > 0")
    nt = dense.filter("is_nt").groupBy(*OUTCOME).agg(F.sum("n").alias("nt_n"))
    nt_total = nt.agg(F.sum("nt_n")).first()[0] or 0
    rows = dense.join(own, "guide").join(nt, OUTCOME)
    expected = safe_ratio(F.col("nt_n"), F.lit(nt_total)) * F.col("total")
    term = F.when(F.col("nt_n") > 0, (F.col("n") - expected) * (F.col("n") - expected) / expected).when(F.col("n") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return rows.groupBy("guide").agg(F.sum(term).alias("chi_squared"))


def active_guides(chi: DataFrame, guides: DataFrame, multiple: float = 2.0) -> DataFrame:
    """Guides whose statistic is above ``multiple`` times the largest one of a control."""
    rows = chi.join(guides.select("guide", "gene", "is_nt"), "guide")
    limit = rows.filter("is_nt").agg(F.max("chi_squared")).first()[0]
    return rows.filter(F.col("chi_squared") > F.lit(multiple * (limit or 0.0)))


def guides_by_activity(chi: DataFrame, guides: DataFrame) -> DataFrame:
    """Guides of every gene in order of activity, the most active first."""
    rows = chi.join(guides.select("guide", "gene"), "guide")
    return rows.withColumn("activity_rank", F.row_number().over(Window.partitionBy("gene").orderBy(F.round("chi_squared", 6).desc(), "guide")))


def choose_count(n: Column, f: Column) -> Column:
    """Binomial coefficient as a running product."""
    return F.when(f <= 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(f, F.lit(1))), F.lit(1.0), lambda acc, i: acc * (n - i + 1) / i))


def k_of_n_less(n: Column, k: Column, p: Column) -> Column:
    """Chance that at least ``k`` of ``n`` uniform values are at most ``p``; 1 for k above n."""
    total = F.aggregate(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), F.lit(0.0), lambda acc, f: acc + choose_count(n, f) * F.pow(1 - p, f) * F.pow(p, n - f))
    return F.when(k > n, F.lit(1.0)).otherwise(total)


def gene_p_values(guides: DataFrame, p: str, max_k: int = 9) -> DataFrame:
    """``gene, n_guides, best_k, p``: the smallest k-of-n chance over k, times the number of tests, at most 1."""
    rows = guides.filter(F.col(p).isNotNull())
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("gene").orderBy(p, "guide")))
    sizes = rows.groupBy("gene").agg(F.count("*").cast("int").alias("n_guides"))
    tested = rows.filter(F.col("k") <= max_k).join(sizes, "gene").withColumn("chance", k_of_n_less(F.col("n_guides"), F.col("k"), F.col(p)))
    best = tested.groupBy("gene", "n_guides").agg(F.min(F.struct("chance", "k")).alias("b"))
    return best.select("gene", "n_guides", F.col("b.k").alias("best_k"), F.least(F.lit(1.0), F.col("b.chance") * F.least(F.lit(max_k), F.col("n_guides"))).alias("p"))


def binomial_p_values(stats: DataFrame) -> DataFrame:
    """Adds the tails ``p_down`` and ``p_up`` of the numerator against the control fraction."""
    args = [F.col("numerator").cast("double"), F.col("denominator").cast("double"), F.col("nt_fraction")]
    return stats.withColumn("p_down", binomial_cdf_udf()(*args)).withColumn("p_up", binomial_at_least_udf()(*args))


def gene_directions(stats: DataFrame, max_k: int = 9) -> DataFrame:
    """Per gene the combined p values of both directions, the relevant one and its -log10."""
    down, up = (gene_p_values(stats, c, max_k).select("gene", F.col("p").alias(c.replace("p_", "gene_p_"))) for c in ("p_down", "p_up"))
    rows = down.join(up, "gene")
    relevant = F.when(F.col("gene_p_up") < F.col("gene_p_down"), "up").otherwise("down")
    least = F.least("gene_p_up", "gene_p_down")
    return rows.withColumn("relevant", relevant).withColumn("minus_log10_p", -F.log10(F.greatest(least, F.lit(2.2250738585072014e-308))))


def with_intervals(stats: DataFrame, k: str = "numerator", n: str = "denominator", alpha: float = 0.05) -> DataFrame:
    """Exact intervals of the fraction, and of the log2 fold change within [-6, 5].

    Every distinct pair of counts is solved once and joined back.
    """
    keys = stats.select(F.col(k).cast("long").alias("_k"), F.col(n).cast("long").alias("_n")).distinct()
    solved = keys.withColumn("_i", clopper_pearson_udf(alpha)(F.col("_k").cast("double"), F.col("_n").cast("double"))).select("_k", "_n", F.col("_i.low").alias("interval_low"), F.col("_i.high").alias("interval_high"))
    rows = stats.join(solved, F.col(k).cast("long").eqNullSafe(F.col("_k")) & F.col(n).cast("long").eqNullSafe(F.col("_n"))).drop("_k", "_n")
    log = lambda c: F.when(F.col("nt_fraction") > 0, F.when(F.col(c) > 0, clamp(F.log2(F.col(c) / F.col("nt_fraction")), -6.0, 5.0)).otherwise(F.lit(-6.0)))
    return rows.withColumn("log2_low", log("interval_low")).withColumn("log2_high", log("interval_high"))


def significance_flags(stats: DataFrame, cutoff: int = 4) -> DataFrame:
    """Direction, one-sided p value and whether it is at most 10 ** -cutoff."""
    rows = binomial_p_values(stats)
    direction = F.when(F.col("frequency") >= F.col("nt_fraction"), "up").otherwise("down")
    rows = rows.withColumn("direction", direction).withColumn("p", F.when(F.col("direction") == "up", F.col("p_up")).otherwise(F.col("p_down")))
    return rows.withColumn("is_significant", F.col("p") <= F.lit(10.0**-cutoff))


def beta_binomial_p_values(stats: DataFrame) -> DataFrame:
    """Tails against a beta-binomial fitted to the controls, doubled, at most 1.

    The fit collects the two counts of every control guide: at most some
    hundred rows, the number of controls in a library.
    """
    nt = stats.filter("is_nt and denominator > 0").select("numerator", "denominator").toPandas()
    a, b = fit_beta_binomial(nt["numerator"].to_numpy(float), nt["denominator"].to_numpy(float))

    def tails(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            both = [beta_binomial_tails(int(k), int(n), a, b) for k, n in zip(part["numerator"], part["denominator"])]
            part["p_down"], part["p_up"] = [min(1.0, 2 * x) for x, _ in both], [min(1.0, 2 * y) for _, y in both]
            yield part

    rows = stats.select("guide", "gene", "is_nt", F.col("numerator").cast("long").alias("numerator"), F.col("denominator").cast("long").alias("denominator"))
    return rows.mapInPandas(tails, "guide string, gene string, is_nt boolean, numerator long, denominator long, p_down double, p_up double")


def extremes(df: DataFrame, value: str, key: str, top: int, bottom: int) -> DataFrame:
    """The ``top`` highest and the ``bottom`` lowest rows with their ranks from either end."""
    high = df.orderBy(F.desc(value), key).limit(top).withColumn("end", F.lit("top"))
    low = df.orderBy(F.asc(value), key).limit(bottom).withColumn("end", F.lit("bottom"))
    return high.unionByName(low)


def blocks(df: DataFrame, key: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Stretches of neighbouring rows with one ``key``: ``first, last`` places, gaps and islands."""
    by = by or []
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    rows = rows.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(*by, key).orderBy("_i")))
    return rows.groupBy(*by, key, "_g").agg(F.min("_i").alias("first"), F.max("_i").alias("last")).drop("_g")


def resampled_nulls(records: DataFrame, cells: int, samples: int, seed: int = 1) -> DataFrame:
    """Counts per outcome in ``samples`` draws of ``cells`` control records, without replacement.

    Every draw takes whole control guides in random order until they hold
    enough records and then a random part of these; ``records`` has ``guide``
    and an ``outcome`` label.  Guides' outcome counts are what is sent to the
    tasks: their number is that of controls times outcomes.
    """
    table = records.groupBy("guide", "outcome").count().orderBy("guide", "outcome").toPandas()
    guides = {g: (t["outcome"].to_numpy(), t["count"].to_numpy()) for g, t in table.groupby("guide")}
    names = sorted(guides)
    spark = records.sparkSession

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for sample in part["id"]:
                rng = np.random.default_rng([seed, int(sample)])
                pool: dict[str, int] = {}
                held = 0
                for i in rng.permutation(len(names)):
                    for o, c in zip(*guides[names[i]]):
                        pool[o] = pool.get(o, 0) + int(c)
                        held += int(c)
                    if held >= cells:
                        break
                keys = sorted(pool)
                if keys:
                    got = rng.multivariate_hypergeometric([pool[k] for k in keys], min(cells, held))
                    yield pd.DataFrame({"sample": int(sample), "outcome": keys, "n": got})

    return spark.range(samples).mapInPandas(draw, "sample long, outcome string, n long")


def null_quantiles(draws: DataFrame, quantiles: list[float], samples: int) -> DataFrame:
    """Integer quantiles per outcome from cumulative frequencies; a draw without the outcome counts 0."""
    seen = draws.filter("n > 0").groupBy("outcome", "n").agg(F.count("*").alias("f"))
    zero = seen.groupBy("outcome").agg((F.lit(samples) - F.sum("f")).alias("f")).withColumn("n", F.lit(0).cast("long")).filter("f > 0")
    rows = seen.unionByName(zero.select("outcome", "n", "f"))
    up_to = F.sum("f").over(Window.partitionBy("outcome").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("share", up_to / F.lit(samples))
    return rows.groupBy("outcome").agg(*[F.min(F.when(F.col("share") >= q - 1e-12, F.col("n"))).alias(f"q{str(q).replace('.', '_')}") for q in quantiles])


#: Sizes and draws of the nulls of the reference.
NULL_CELLS = [*range(10, 100, 5), *range(100, 1000, 50), *range(1000, 5000, 100), *range(5000, 20000, 1000), *range(20000, 40000, 5000)]
NULL_SAMPLES = 100_000
NULL_GROUPS = ("deletion", "insertion", "partial_donor")


def null_frequencies(records: DataFrame, cells: list[int], samples: int, seed: int = 1, chunk: int = 500) -> DataFrame:
    """``cells, outcome, n, f``: in how many of ``samples`` draws of so many control records an outcome, or a group of outcomes, counts ``n`` > 0.

    Every draw takes control guides at random, with replacement, until they
    hold enough records, and then a random part of these without replacement.
    ``records`` has ``guide, outcome`` and the ``group`` of the outcome or null.
    Chunks of draws are spread over tasks and come back as histograms.
    """
    table = records.groupBy("guide", "outcome", "group").count().orderBy("guide", "outcome").toPandas()
    names = sorted(table["outcome"].unique())
    group_of = dict(zip(table["outcome"], table["group"]))
    members = [np.array([group_of[o] == g for o in names], bool) for g in NULL_GROUPS]
    held = table.pivot_table(index="guide", columns="outcome", values="count", fill_value=0).reindex(columns=names).to_numpy(np.int64) if names else np.zeros((0, 0), np.int64)
    sizes, labels = held.sum(1), [*names, *NULL_GROUPS]

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for size, first, last in zip(part["cells"], part["first"], part["last"]):
                got = np.zeros((last - first, len(labels)), np.int64)
                rng = np.random.default_rng([seed, int(size), int(first)])
                for i in range(last - first):
                    times, n = np.zeros(len(sizes), np.int64), 0
                    while n < size:
                        g = rng.integers(len(sizes))
                        times[g] += 1
                        n += sizes[g]
                    got[i, : len(names)] = rng.multivariate_hypergeometric(times @ held, int(size), method="marginals")
                for k, m in enumerate(members):
                    got[:, len(names) + k] = got[:, : len(names)][:, m].sum(1)
                at = np.nonzero(got)
                keys, f = np.unique(at[1] * (int(size) + 1) + got[at], return_counts=True)
                yield pd.DataFrame({"cells": int(size), "outcome": [labels[k] for k in keys // (int(size) + 1)], "n": keys % (int(size) + 1), "f": f})

    spark = records.sparkSession
    work = [(c, a, min(a + chunk, samples)) for c in cells for a in range(0, samples, chunk)] if names else []
    tasks = spark.createDataFrame(work, "cells long, first long, last long")
    # large draws take longer: they are spread evenly
    tasks = tasks.repartition(max(1, min(len(work), 400)), F.xxhash64("cells", "first"))
    return tasks.mapInPandas(draw, "cells long, outcome string, n long, f long").groupBy("cells", "outcome", "n").agg(F.sum("f").alias("f"))


def null_grid_quantiles(frequencies: DataFrame, cells: list[int], samples: int) -> DataFrame:
    """``cells, outcome, median, down_1, up_1, ...``: quantiles down to 10 ** -k and up to 1 - 10 ** -k from cumulative frequencies.

    Draws without the outcome count 0; the groups and ``not_observed`` have a row for every size.
    A low quantile is the first count that so many draws do not exceed, a high
    one the first count that fewer draws reach.
    """
    always = frequencies.sparkSession.createDataFrame([(c, o) for c in cells for o in (*NULL_GROUPS, "not_observed")], "cells long, outcome string")
    seen = frequencies.groupBy("cells", "outcome").agg(F.sum("f").alias("seen"))
    zero = seen.join(always, ["cells", "outcome"], "full").select("cells", "outcome", F.lit(0).cast("long").alias("n"), (F.lit(samples) - F.coalesce("seen", F.lit(0))).alias("f"))
    w = Window.partitionBy("cells", "outcome")
    rows = frequencies.unionByName(zero).withColumn("leq", F.sum("f").over(w.orderBy("n"))).withColumn("geq", F.lit(samples) - F.col("leq") + F.col("f"))
    low = lambda k: F.min(F.when(F.col("leq") * 10**k >= samples, F.col("n")))
    high = lambda k: F.max(F.when(F.col("geq") * 10**k >= samples, F.col("n"))) + 1
    exponents = range(1, int(np.log10(samples)) + 1)
    return rows.groupBy("cells", "outcome").agg(F.min(F.when(F.col("leq") * 2 >= samples, F.col("n"))).alias("median"), *[c for k in exponents for c in (low(k).alias(f"down_{k}"), high(k).alias(f"up_{k}"))])
