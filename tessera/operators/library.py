"""The guide library as a dimension: promoters, controls, names and combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.folding import fold_name

NON_TARGETING = "non-targeting"
DEFAULT_PROMOTER = "P1P2"


def guide_dimension(library: DataFrame, preferred: DataFrame | None = None, excluded: list[str] | None = None) -> DataFrame:
    """One row per folded guide name with promoter, rank and flags.

    A null promoter is ``P1P2``.  ``preferred`` (gene, best_promoter) makes the
    other promoters of its genes not the best ones; any other guide is.
    """
    rows = library.withColumn("guide", fold_name("short_name")).filter("guide is not null").dropDuplicates(["guide"])
    rows = rows.select("guide", "gene", F.coalesce("promoter", F.lit(DEFAULT_PROMOTER)).alias("promoter"), F.col("guide_rank").alias("rank"), "protospacer", "full_seq", "guide_barcode", "gamma", (F.col("gene") == NON_TARGETING).alias("is_nt"))
    if preferred is not None:
        rows = rows.join(preferred.select("gene", "best_promoter"), "gene", "left").withColumn("is_best_promoter", F.coalesce(F.col("promoter") == F.col("best_promoter"), F.lit(True))).drop("best_promoter")
    else:
        rows = rows.withColumn("is_best_promoter", F.lit(True))
    return rows.filter(~F.col("guide").isin(*excluded)) if excluded else rows


def is_control(name: Column) -> Column:
    """Controls by their name."""
    return F.lower(name).contains("nontarg") | F.lower(name).contains(NON_TARGETING)


def control_sets(guides: DataFrame, size: int = 4) -> DataFrame:
    """Controls in order of name, cut into sets of ``size``: ``set_name, guide``; raises if they do not divide evenly."""
    rows = guides.filter("is_nt").withColumn("i", F.row_number().over(Window.partitionBy("is_nt").orderBy("guide")) - 1)
    n = rows.count()
    if n % size:
        raise ValueError(f"{n} controls do not make sets of {size}")
    return rows.select(F.format_string("non_targeting_set_%d", F.floor(F.col("i") / size).cast("int")).alias("set_name"), "guide")


def with_set_names(guides: DataFrame, sets: DataFrame) -> DataFrame:
    """Gene names with those of control sets in place of the common name."""
    return guides.join(sets, "guide", "left").withColumn("gene", F.coalesce("set_name", "gene")).drop("set_name")


def rename_genes(df: DataFrame, renamed: DataFrame, gene: str = "gene", backwards: bool = False) -> DataFrame:
    """Old to new names (or back); a name without an entry stays."""
    a, b = ("new_name", "old_name") if backwards else ("old_name", "new_name")
    pairs = renamed.select(F.col(a).alias("_from"), F.col(b).alias("_to"))
    return df.join(pairs, F.col(gene) == F.col("_from"), "left").withColumn(gene, F.coalesce("_to", gene)).drop("_from", "_to")


def unique_display_names(genes: DataFrame) -> DataFrame:
    """``gene_id, name``: the first name of every id; a name that other ids have too gets ``_2``, ``_3``, ... from the second id on.

    ``genes`` has ``gene_id, name, seen`` with the order of the entries.
    """
    first = genes.withColumn("_r", F.row_number().over(Window.partitionBy("gene_id").orderBy("seen"))).filter("_r = 1")
    rows = first.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("seen", "gene_id")))
    return rows.select("gene_id", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("_n").cast("string"))).alias("name"))


def gene_guides(guides: DataFrame, genes: list[str], only_best: bool = False) -> DataFrame:
    rows = guides.filter(F.col("gene").isin(*genes))
    return (rows.filter("is_best_promoter") if only_best else rows).orderBy("gene", "promoter", "rank", "guide")


def combinations(fixed: DataFrame, variable: DataFrame) -> DataFrame:
    """All pairs of fixed and variable guides; both are parts of a library of some thousand guides."""
    return fixed.select(F.col("guide").alias("fixed_guide"), F.col("gene").alias("fixed_gene"), F.col("is_nt").alias("fixed_nt")).join(variable.select(F.col("guide").alias("variable_guide"), F.col("gene").alias("variable_gene"), F.col("is_nt").alias("variable_nt")), F.lit(True))


def combinations_for_gene(pairs: DataFrame, gene: str) -> DataFrame:
    """The gene's fixed guides with its own and the control variable ones, and control fixed guides with its variable ones."""
    f, v = F.col("fixed_gene") == gene, F.col("variable_gene") == gene
    return pairs.filter((f & (v | F.col("variable_nt"))) | (F.col("fixed_nt") & v)).select("fixed_guide", "variable_guide").distinct()


def combinations_for_gene_pair(pairs: DataFrame, a: str, b: str, ordered: bool = False) -> DataFrame:
    one = (F.col("fixed_gene") == a) & (F.col("variable_gene") == b)
    other = (F.col("fixed_gene") == b) & (F.col("variable_gene") == a)
    return pairs.filter(one if ordered else one | other).select("fixed_guide", "variable_guide")


def name_groups(guides: DataFrame) -> DataFrame:
    """First and last place, and number, of the guides of every first letter, in order of name."""
    rows = guides.select("guide").withColumn("i", F.row_number().over(Window.orderBy("guide")) - 1)
    return rows.groupBy(F.substring("guide", 1, 1).alias("letter")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.avg("i").alias("middle"))


def reindex(labels: DataFrame, data: DataFrame, on: list[str], values: dict[str, object]) -> DataFrame:
    """Exactly the given labels, with ``values`` where the data has none."""
    out = labels.join(data, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})
