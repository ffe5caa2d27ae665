"""Outcome counts in long form: an absent (outcome, guide) pair is a count of zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

OUTCOME = ["category", "subcategory", "details"]
#: Categories that keep their subcategory and lose their details, and those that keep the details.
DETAILS_COLLAPSED = ("genomic insertion", "donor misintegration")
SUBCATEGORY_COLLAPSED = ("donor",)
COLLAPSED = "collapsed"
ALL_NON_TARGETING = "all_non_targeting"
SHORT, LONG = "<=75 nts", ">75 nts"


def collapse_categories(df: DataFrame, details_collapsed: tuple[str, ...] = DETAILS_COLLAPSED, subcategory_collapsed: tuple[str, ...] = SUBCATEGORY_COLLAPSED) -> DataFrame:
    """Rewrite outcome keys before they are counted, in one pass with the count."""
    return df.withColumns(
        {
            "subcategory": F.when(F.col("category").isin(*subcategory_collapsed), COLLAPSED).otherwise(F.col("subcategory")),
            "details": F.when(F.col("category").isin(*details_collapsed), COLLAPSED).otherwise(F.col("details")),
        }
    )


def outcome_counts(records: DataFrame, by: list[str], collapsed: bool = True) -> DataFrame:
    """``*by, category, subcategory, details, n`` over all records."""
    rows = collapse_categories(records) if collapsed else records
    return rows.groupBy(*by, *OUTCOME).agg(F.count("*").alias("n"))


def totals(counts: DataFrame, by: list[str], name: str = "total") -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n").alias(name))


def pooled_controls(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per outcome over all non-targeting guides; ``counts`` has ``is_nt``."""
    return counts.filter("is_nt").groupBy(*(by or []), *OUTCOME).agg(F.sum("n").alias("nt_n"))


def share_of_total(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Adds the share of ``value`` within ``by``; the totals are aggregated and joined, not put into one window."""
    if by:
        whole = df.groupBy(*by).agg(F.sum(value).alias("_whole"))
        out = df.join(whole, by)
    else:
        whole = df.agg(F.sum(value)).first()[0] or 0
        out = df.withColumn("_whole", F.lit(whole))
    return out.withColumn(name, F.col(value).cast("double") / F.nullif(F.col("_whole").cast("double"), F.lit(0.0))).drop("_whole")


def most_frequent(outcomes: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` outcomes with the largest ``by``, ties by key; a top-k, not a full sort."""
    return outcomes.orderBy(F.desc(by), *OUTCOME).limit(k)


def category_counts(counts: DataFrame, excluded: tuple[str, ...] = ("malformed layout",)) -> DataFrame:
    """Counts per guide at both levels by one rollup, with a column of all controls.

    ``guide, category, subcategory, n``; a null subcategory is the category as a
    whole, ``guide = all_non_targeting`` the sum over the controls.
    """
    rows = counts.filter(~F.col("category").isin(*excluded))
    labelled = rows.select(F.explode(F.when(F.col("is_nt"), F.array(F.col("guide"), F.lit(ALL_NON_TARGETING))).otherwise(F.array("guide"))).alias("guide"), "category", "subcategory", "n")
    rolled = labelled.rollup("guide", "category", "subcategory").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    return rolled.filter("level <= 1").select("guide", "category", "subcategory", "n")


def split_foreign_lengths(counts: DataFrame, lengths: DataFrame, cutoff: int = 75, category: str = "genomic insertion") -> DataFrame:
    """Replace the collapsed rows of ``category`` by a short and a long row.

    ``lengths`` has ``guide, subcategory, length, n``.  A guide without lengths
    keeps its row.
    """
    target = (F.col("category") == category) & (F.col("details") == COLLAPSED)
    rows = lengths.groupBy("guide", "subcategory", F.when(F.col("length") <= cutoff, SHORT).otherwise(LONG).alias("details")).agg(F.sum("n").alias("n"))
    split = rows.select("guide", F.lit(category).alias("category"), "subcategory", "details", "n")
    kept = counts.filter(~target)
    unsplit = counts.filter(target).join(rows.select("guide", "subcategory").distinct(), ["guide", "subcategory"], "left_anti")
    cols = ["guide", *OUTCOME, "n"]
    return kept.select(*cols).unionByName(split.select(*cols)).unionByName(unsplit.select(*cols))


def with_leftover(counts: DataFrame, common: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the ``common`` outcomes and one row ('uncommon', 'uncommon', 'collapsed') for the rest."""
    flagged = counts.join(common.select(*OUTCOME).withColumn("_common", F.lit(True)), OUTCOME, "left")
    key = lambda c, rest: F.when(F.col("_common"), F.col(c)).otherwise(F.lit(rest)).alias(c)
    rows = flagged.select(*by, key("category", "uncommon"), key("subcategory", "uncommon"), key("details", COLLAPSED), "n")
    return rows.groupBy(*by, *OUTCOME).agg(F.sum("n").alias("n"))


def densify(keys: DataFrame, others: DataFrame, facts: DataFrame, on: list[str], values: dict[str, object]) -> DataFrame:
    """All pairs of two dimension tables with the facts, absent values filled.

    Both dimensions are small by definition (guides, selected outcomes); the
    size of the product is what a dense matrix has.
    """
    grid = keys.join(others, F.lit(True))
    out = grid.join(facts, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def merge_pools(*pools: DataFrame) -> DataFrame:
    """Sum of several count tables with the same columns."""
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def ranked_over_all(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers from 1 over the whole table without one task for all rows.

    The table is ranged by ``order`` and written; a row's number is its place in
    its range plus the rows of the ranges before, of which there are as many as
    partitions.  ``order`` must be total for a defined result.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_p").count().orderBy("_p").collect()
    before, rows = 0, []
    for r in sizes:
        rows.append((r[0], before))
        before += r[1]
    offsets = df.sparkSession.createDataFrame(rows, "_p int, _before long")
    placed = ranged.join(offsets, "_p").withColumn(name, (F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(*order))).cast("long"))
    return placed.drop("_p", "_before")
