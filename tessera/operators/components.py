"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, release


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: link the neighbours of every node to its least neighbour.

    The least neighbours come from a plain aggregate, with partial sums before
    the shuffle, so a node with very many links is neither one group nor
    collected.  They are joined back by node, where such a node is one key: the
    adaptive execution splits its partition over tasks.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of a link; the component is its least node.

    Alternating large-star and small-star operations until nothing changes;
    every round is written to the shared folder, which cuts the lineage.  Links
    with a null end and links of a node to itself are left out; an empty table
    gives no row.  Raises ``RuntimeError`` if ``max_rounds`` do not suffice.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(), name)
    done = None
    for _ in range(max_rounds):
        # a star forest is done: no centre is itself linked to a smaller node, every leaf has one centre
        done = _settled(edges)
        if done:
            break
        nxt = materialize(_stars(_stars(edges, large=True), large=False), name)
        release(edges)
        edges = nxt
    if not done:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every node is a centre or a leaf of one centre only."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).cast("long").alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v").alias("x"), F.lit(0).cast("long"), F.lit(1)))
    bad = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
    return bad.limit(1).count() == 0
