"""Queries on pools, replicates, correlations, clusters and cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import cells as L
from tessera.operators import clustering as G
from tessera.operators import correlation as R
from tessera.operators import counts as C
from tessera.operators import normalise as N
from tessera.operators import statistics as S
from tessera.plans import facts
from tessera.plans.facts import SQL
from tessera.session import materialize
from tessera.sources.tables import table

OUTCOME = C.OUTCOME
r6 = lambda c: F.round(c, 6)
r4 = lambda c: F.round(c, 4)


def zero(expression: str, digits: int) -> str:
    """SQL that rounds and has no negative zero."""
    return f"(case when abs({expression}) < {0.5 * 10**-digits} then 0.0 else round({expression}, {digits}) end)"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = prefix + sql
        return f

    return add


# log2 fold changes of all guides with records over the most frequent outcomes
_SEL = """, m as (select guide, category || '|' || subcategory || '|' || details as outcome, dense_rank() over (order by guide) as gi, dense_rank() over (order by category, subcategory, details) as oi, log2_fc as x from fc where total > 0)
"""
# the pairs by number, which is much faster than by name
_COR = _SEL + f""", v as (select gi, any_value(guide) as guide, max(x) > min(x) as varies from m group by gi),
pn as (select a.gi as i, b.gi as j, corr(a.x, b.x) as r, sum(a.x * b.x) / sqrt(nullif(sum(a.x * a.x) * sum(b.x * b.x), 0)) as cosine, 1 / (1 + sqrt(sum((a.x - b.x) * (a.x - b.x)))) as euclidean from m a join m b on a.oi = b.oi and a.gi < b.gi group by all),
pr as (select va.guide as a, vb.guide as b, case when va.varies and vb.varies then {zero("pn.r", 4)} end as r, cosine, euclidean from pn join v va on va.gi = i join v vb on vb.gi = j)
"""


def _matrix(spark, folder):
    """log2 fold changes of the most frequent outcomes for all guides with records."""
    cnt = facts.counts(spark, folder)
    rows = N.log2_fold_changes(cnt, facts.guides(spark, folder).select("guide"), facts.frequent(cnt)).filter("total > 0")
    return materialize(rows.select("guide", *OUTCOME, F.col("log2_fc").alias("x")), "matrix")


@query(_COR + "select a, b, round(r, 4) as r from pr")
def guide_pair_correlation(spark, folder):
    return R.correlations(_matrix(spark, folder), "guide", OUTCOME, "x").withColumn("r", r4("r"))


@query(
    _SEL
    + f""", w as (select oi, any_value(outcome) as outcome, max(x) > min(x) as varies from m group by oi), pn as (select a.oi as i, b.oi as j, corr(a.x, b.x) as r from m a join m b on a.gi = b.gi and a.oi < b.oi group by all)
select least(x.outcome, y.outcome) as a, greatest(x.outcome, y.outcome) as b, case when x.varies and y.varies then {zero("r", 4)} end as r from pn join w x on x.oi = i join w y on y.oi = j"""
)
def outcome_pair_correlation(spark, folder):
    rows = _matrix(spark, folder).select(F.concat_ws("|", *OUTCOME).alias("item"), "guide", "x")
    return R.correlations(rows, "item", ["guide"], "x").withColumn("r", r4("r"))


@query(_COR + "select a, b, round(r, 4) as correlation, round(cosine, 4) as cosine, round(euclidean, 4) as euclidean from pr")
def guide_similarities(spark, folder):
    out = R.similarities(_matrix(spark, folder), "guide", OUTCOME, "x")
    return out.select("a", "b", *[r4(c).alias(c) for c in ("correlation", "cosine", "euclidean")])


@query(_COR + "select least(x.gene, y.gene) as gene_a, greatest(x.gene, y.gene) as gene_b, round(max(r), 4) as highest from pr join lib x on x.guide = a join lib y on y.guide = b group by all")
def max_gene_pair_correlation(spark, folder):
    pairs = R.correlations(_matrix(spark, folder), "guide", OUTCOME, "x")
    return R.best_gene_pairs(pairs, facts.guides(spark, folder)).withColumn("highest", r4("highest"))


@query(_COR + ", b2 as (select a, b, r from pr where r is not null union all select b, a, r from pr where r is not null), k as (select a, b, round(r, 4) as r, row_number() over (partition by a order by round(r, 4) desc, b) as rank_high, row_number() over (partition by a order by round(r, 4), b) as rank_low from b2) select * from k where rank_high <= 5 or rank_low <= 5")
def ranked_partners(spark, folder):
    pairs = materialize(R.correlations(_matrix(spark, folder), "guide", OUTCOME, "x").withColumn("r", r4("r")), "pairs")
    return R.ranked_partners(pairs, "r", 5).select("a", "b", "r", F.col("rank_high").cast("long").alias("rank_high"), F.col("rank_low").cast("long").alias("rank_low"))


@query(_COR + ", l as (select round(r, 4) as r, x.gene = y.gene as same_gene from pr join lib x on x.guide = a join lib y on y.guide = b where r between -1 and 1), h as (select same_gene, cast(least(floor((r + 1) / (2::double / 30)), 29) as int) as bin, count(*) as n from l group by all) select same_gene, bin, n, round(n / (sum(n) over (partition by same_gene) * (2::double / 30)), 6) as density from h")
def same_gene_histogram(spark, folder):
    g = facts.guides(spark, folder).select("guide", "gene")
    pairs = R.correlations(_matrix(spark, folder), "guide", OUTCOME, "x").join(g.select(F.col("guide").alias("a"), F.col("gene").alias("ga")), "a").join(g.select(F.col("guide").alias("b"), F.col("gene").alias("gb")), "b")
    return R.histogram(pairs.withColumn("same_gene", F.col("ga") == F.col("gb")).withColumn("r", r4("r")), ["same_gene"], "r", -1.0, 1.0, 30).withColumn("density", r6("density"))


# -- replicates: all guides of two sites --------------------------------

_REP = """, pc as (select pool, guide, category, count(*) as n from gr where perfect and pool in ('A', 'B') group by all), pt as (select pool, guide, sum(n) as total from pc group by all),
sel as (select guide from pt group by guide having count(*) = 2), cats as (select distinct category from pc),
rm as (select case p.pool when 'A' then 0 else 1 end as rep, s.guide, c.category, coalesce(pc.n, 0) / pt.total as x from (values ('A'), ('B')) as p(pool) cross join sel s cross join cats c join pt on pt.pool = p.pool and pt.guide = s.guide left join pc on pc.pool = p.pool and pc.guide = s.guide and pc.category = c.category)
"""


def _replicates(spark, folder):
    pc = materialize(facts.guided(spark, folder).filter("perfect and pool in ('A', 'B')").groupBy("pool", "guide", "category").agg(F.count("*").alias("n")), "replicate-counts")
    pt = C.totals(pc, ["pool", "guide"])
    chosen = pt.groupBy("guide").agg(F.count("*").alias("k")).filter("k = 2").select("guide")
    grid = pt.join(chosen, "guide", "left_semi").join(pc.select("category").distinct(), F.lit(True))
    rows = grid.join(pc, ["pool", "guide", "category"], "left").withColumn("x", F.coalesce("n", F.lit(0)) / F.col("total"))
    return materialize(rows.select(F.when(F.col("pool") == "A", 0).otherwise(1).alias("rep"), "guide", "category", "x"), "replicates")


@query(_REP + "select guide, category, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std from rm group by all")
def replicate_mean_std(spark, folder):
    return _replicates(spark, folder).groupBy("guide", "category").agg(r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x")).alias("std"))


@query(_REP + "select category, case when stddev_samp(a.x) > 0 and stddev_samp(b.x) > 0 then " + zero("corr(a.x, b.x)", 6) + " end as r from rm a join rm b using (guide, category) where a.rep = 0 and b.rep = 1 group by category")
def replicate_outcome_r(spark, folder):
    return R.item_replicate_r(_replicates(spark, folder), "category", ["guide"], "rep", "x").withColumn("r", r6("r"))


@query(_REP + "select guide, case when stddev_samp(a.x) > 0 and stddev_samp(b.x) > 0 then " + zero("corr(a.x, b.x)", 6) + " end as r from rm a join rm b using (guide, category) where a.rep = 0 and b.rep = 1 group by guide")
def replicate_guide_r(spark, folder):
    return R.item_replicate_r(_replicates(spark, folder), "guide", ["category"], "rep", "x").withColumn("r", r6("r"))


@query(
    _REP
    + """select 'replicate_' || a.rep as part, a.category as a, b.category as b, case when stddev_samp(a.x) > 0 and stddev_samp(b.x) > 0 then """ + zero("corr(a.x, b.x)", 6) + """ end as r from rm a join rm b using (guide, rep) where a.category < b.category group by all
union all select 'between', category, category, case when stddev_samp(a.x) > 0 and stddev_samp(b.x) > 0 then """ + zero("corr(a.x, b.x)", 6) + """ end from rm a join rm b using (guide, category) where a.rep = 0 and b.rep = 1 group by category"""
)
def replicate_r_matrix(spark, folder):
    return R.replicate_correlations(_replicates(spark, folder), "category", ["guide"], "rep", "x").select("part", "a", "b", r6("r").alias("r"))


@query("select guide, category, subcategory, details, cast(sum(n) as bigint) as n from (select pool, guide, category, subcategory, details, count(*) as n from kr where perfect group by all) group by guide, category, subcategory, details")
def merged_pools(spark, folder):
    per_pool = materialize(C.outcome_counts(facts.guided(spark, folder).filter("perfect"), ["pool", "guide"]), "pools")
    pools = sorted(r.pool for r in per_pool.select("pool").distinct().collect())
    return C.merge_pools(*[per_pool.filter(F.col("pool") == p).drop("pool") for p in pools])


@query("select guide from gr group by guide having count(distinct pool) = (select count(distinct pool) from gr)")
def common_guides(spark, folder):
    rows = materialize(facts.guided(spark, folder).select("pool", "guide").distinct(), "pool-guides")
    pools = sorted(r.pool for r in rows.select("pool").distinct().collect())
    common = rows.filter(F.col("pool") == pools[0]).select("guide") if pools else rows.select("guide")
    for p in pools[1:]:
        common = common.intersect(rows.filter(F.col("pool") == p).select("guide"))
    return common


@query("select distinct category, subcategory, details from kr")
def outcome_union(spark, folder):
    return C.collapse_categories(facts.guided(spark, folder)).select(*OUTCOME).distinct()


@query("select distinct category from gr where pool = 'A' except select category from gr where pool = 'C' and category in ('deletion', 'insertion')")
def category_difference(spark, folder):
    rows = facts.guided(spark, folder)
    return rows.filter("pool = 'A'").select("category").subtract(rows.filter("pool = 'C' and category in ('deletion', 'insertion')").select("category"))


_POOLCHI = """, pk as (select pool, guide, gene, is_nt, category, count(*) as n from gr where perfect group by all), pt as (select pool, guide, gene, is_nt, sum(n) as total from pk group by all), pn as (select pool, category, sum(n) as c from pk where is_nt group by all), ps as (select pool, sum(c) as s from pn group by pool),
px as (select pt.pool, pt.guide, pt.gene, pt.is_nt, sum(pow(coalesce(pk.n, 0) - pn.c / ps.s * pt.total, 2) / (pn.c / ps.s * pt.total)) as chi from pt join pn on pn.pool = pt.pool join ps on ps.pool = pt.pool left join pk on pk.pool = pt.pool and pk.guide = pt.guide and pk.category = pn.category group by all),
rk as (select *, row_number() over (partition by pool order by round(chi, 6) desc, guide) as place from px)
"""


def _pool_chi(spark, folder):
    pk = materialize(facts.guided(spark, folder).filter("perfect").groupBy("pool", "guide", "gene", "is_nt", "category").agg(F.count("*").alias("n")), "pool-categories")
    pt = C.totals(pk, ["pool", "guide", "gene", "is_nt"])
    pn = pk.filter("is_nt").groupBy("pool", "category").agg(F.sum("n").alias("c"))
    shares = C.share_of_total(pn, "c", "p", ["pool"])
    rows = pt.join(shares, "pool").join(pk.select("pool", "guide", "category", "n"), ["pool", "guide", "category"], "left")
    e = F.col("p") * F.col("total")
    chi = rows.groupBy("pool", "guide", "gene", "is_nt").agg(F.sum((F.coalesce("n", F.lit(0)) - e) * (F.coalesce("n", F.lit(0)) - e) / e).alias("chi"))
    return C.ranked(chi, ["pool"], [F.round("chi", 6).desc(), F.asc("guide")], "place")


@query(
    _POOLCHI
    + ", a as (select guide, gene, count(*) filter (place <= 200) as active, avg(place) as mean_place from rk group by all having count(*) filter (place <= 200) >= 2), k as (select *, row_number() over (partition by gene order by mean_place, guide) as r from a) select guide, gene, active, round(mean_place, 6) as mean_place from k where r <= 3"
)
def multi_pool_guides(spark, folder):
    """Guides among the most active ones of at least two pools, three of a gene at most."""
    rows = _pool_chi(spark, folder)
    a = rows.groupBy("guide", "gene").agg(F.sum((F.col("place") <= 200).cast("long")).alias("active"), F.avg("place").alias("mean_place")).filter("active >= 2")
    return C.ranked(a, ["gene"], [F.asc("mean_place"), F.asc("guide")], "r").filter("r <= 3").select("guide", "gene", "active", r6("mean_place").alias("mean_place"))


@query(_POOLCHI + "select distinct guide from rk where place <= 40 and guide in (select guide from pt group by guide having count(*) = (select count(distinct pool) from pt))")
def union_of_top_guides(spark, folder):
    rows = materialize(_pool_chi(spark, folder), "pool-chi")
    pools = rows.select("pool").distinct().count()
    everywhere = rows.groupBy("guide").agg(F.countDistinct("pool").alias("k")).filter(F.col("k") == pools).select("guide")
    return rows.filter("place <= 40").select("guide").distinct().join(everywhere, "guide", "left_semi")


@query(", s as (select pool, guide, category, count(*) as n from gr where perfect group by all) select pool || '|' || category as outcome, guide, n from s")
def stacked_pools(spark, folder):
    rows = facts.guided(spark, folder).filter("perfect").groupBy("pool", "guide", "category").agg(F.count("*").alias("n"))
    return rows.select(F.concat_ws("|", "pool", "category").alias("outcome"), "guide", "n")


@query(", t as (select gene, guide, total, row_number() over (order by total desc, guide) - 1 as i from own join lib using (guide)), x as (select gene, i, i - row_number() over (partition by gene order by i) as g from t) select gene, min(i) as first, max(i) as last from x group by gene, g")
def cluster_blocks(spark, folder):
    rows = C.totals(facts.counts(spark, folder), ["guide"]).join(facts.guides(spark, folder).select("guide", "gene"), "guide")
    return S.blocks(rows, "gene", [F.desc("total"), F.asc("guide")]).select("gene", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def _distances(spark, folder):
    pairs = R.correlations(_matrix(spark, folder), "guide", OUTCOME, "x")
    return materialize(pairs.withColumn("distance", F.lit(1.0) - F.coalesce("r", F.lit(0.0))), "distances")


@query()
def hierarchical_clusters(spark, folder):
    return G.hierarchical(_distances(spark, folder), "distance")


@query()
def density_clusters(spark, folder):
    return G.density(_distances(spark, folder), "distance")


@query()
def cluster_gene_composition(spark, folder):
    return G.cluster_genes(G.hierarchical(_distances(spark, folder), "distance"), facts.guides(spark, folder))


@query(_COR + ", b2 as (select a, b, r from pr where r is not null union all select b, a, r from pr where r is not null), k as (select a, b, round(r, 4) as r, row_number() over (partition by a order by round(r, 4) desc, b) as place from b2) select a, b, r, place, lib.gene from k join lib on lib.guide = k.a where place <= 10")
def neighbour_graph(spark, folder):
    """The ten nearest guides of every guide with its gene: what an embedding starts from."""
    pairs = materialize(R.correlations(_matrix(spark, folder), "guide", OUTCOME, "x").filter("r is not null").withColumn("r", r4("r")), "pairs")
    rows = C.ranked(R.both_ways(pairs, "r"), ["a"], [F.desc("r"), F.asc("b")], "place").filter("place <= 10")
    return rows.join(facts.guides(spark, folder).select(F.col("guide").alias("a"), "gene"), "a").select("a", "b", "r", F.col("place").cast("long").alias("place"), "gene")


# -- cells: users of the event table stand for cells, event types for features ---


def _cells(spark, folder):
    return table(spark, folder, "events").filter("user_id is not null").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("feature")).agg(F.count("*").alias("n"))


@query("with c as (select user_id as cell, event_type as feature, count(*) as n from events where user_id is not null group by all) select cell, cast(sum(n) as bigint) as total, max(n) as highest, arg_max(feature, (n, feature)) as highest_feature, round(max(n) / sum(n), 6) as share_highest from c group by cell", "")
def cell_guide_calls(spark, folder):
    return L.cell_metrics(_cells(spark, folder)).withColumn("share_highest", r6("share_highest"))


@query("with c as (select user_id as cell, event_type as feature, count(*) as n from events where user_id is not null and event_type <> 'click' group by all), g as (select cell, sum(n) as total from c group by cell), a as (select distinct user_id as cell from events where user_id is not null) select a.cell, cast(coalesce(g.total, 0) as bigint) as total from a left join g on g.cell = a.cell", "")
def aligned_cells(spark, folder):
    rows = _cells(spark, folder)
    return L.aligned_cells(rows.select("cell").distinct(), L.cell_metrics(rows.filter("feature <> 'click'"))).select("cell", "total")


@query("with c as (select user_id as cell, event_type as feature, count(*) as n from events where user_id is not null group by all) select cell || '-' || lane as cell, feature, n from c cross join (values ('1'), ('2')) as t(lane)", "")
def lanes_combined(spark, folder):
    rows = _cells(spark, folder)
    return L.with_lane({"1": rows, "2": rows})


@query()
def mixture_calls(spark, folder):
    return L.guide_calls(L.mixture_calls(_cells(spark, folder)))


@query()
def bootstrap_knockdown(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type", F.abs(F.coalesce("value", F.lit(0.0))).alias("a"), F.lit(1.0).alias("b"))
    return L.knockdown(L.bootstrap_fractions(rows, "event_type", "a", "b"), "click")


@query()
def example_reads(spark, folder):
    """Three records of every category, the same ones at every run."""
    return L.example_rows(facts.guided(spark, folder).select("record_id", "category", "subcategory"), ["category"], 3)
