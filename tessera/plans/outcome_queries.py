"""Queries on outcome counts, fractions, fold changes and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.outcomes import deletion_length
from tessera.functions.ratios import clamped_log2, log2_fold_change, log2_or_null, log10_floor, safe_ratio
from tessera.operators import counts as C
from tessera.operators import normalise as N
from tessera.operators import statistics as S
from tessera.plans import facts
from tessera.plans.facts import SQL
from tessera.session import materialize

OUTCOME = C.OUTCOME
r6 = lambda c: F.round(c, 6)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = prefix + sql
        return f

    return add


@query("select guide, perfect, category, subcategory, details, count(*) as n from gr group by all")
def outcome_counts(spark: SparkSession, folder: str) -> DataFrame:
    return C.outcome_counts(facts.guided(spark, folder), ["guide", "perfect"], collapsed=False)


@query("select guide, category, subcategory, details, count(*) as n from kr where perfect group by all")
def outcome_counts_collapsed(spark, folder):
    return C.outcome_counts(facts.guided(spark, folder).filter("perfect"), ["guide"])


@query("select guide, category, subcategory, details, count(*) as n from kr group by all")
def outcome_counts_all_guides(spark, folder):
    return C.outcome_counts(facts.guided(spark, folder), ["guide"])


@query("select guide, count(*) filter (perfect) as perfect_total, count(*) as total from gr group by guide")
def umi_totals(spark, folder):
    return facts.guided(spark, folder).groupBy("guide").agg(F.sum(F.col("perfect").cast("long")).alias("perfect_total"), F.count("*").alias("total"))


@query("select category, subcategory, details, cast(sum(n) as bigint) as total from cnt group by all")
def outcome_totals(spark, folder):
    return C.totals(C.outcome_counts(facts.guided(spark, folder).filter("perfect"), ["guide"]), OUTCOME)


@query("select category, subcategory, details, cast(nt_n as bigint) as nt_n, round(nt_fraction, 6) as nt_fraction from ntf")
def nt_fractions(spark, folder):
    return N.baseline(facts.counts(spark, folder)).withColumn("nt_fraction", r6("nt_fraction"))


@query(
    """, both_ as (select guide, category, subcategory, details, n from cnt union all select 'all_non_targeting', category, subcategory, details, nt_n from nt)
select guide, category, subcategory, details, cast(n as bigint) as n, round(n / sum(n) over (partition by guide), 6) as fraction from both_"""
)
def outcome_fractions(spark, folder):
    return N.outcome_fractions(facts.counts(spark, folder)).withColumn("fraction", r6("fraction"))


@query(
    """, grid as (select lib.guide, o.* from lib cross join (select distinct category, subcategory, details from cnt) o),
whole as (select grid.*, coalesce(cnt.n, 0) as n, coalesce(cnt.n, 0) / nullif(own.total, 0) as fraction, coalesce(ntf.nt_fraction, 0) as base from grid left join cnt using (guide, category, subcategory, details) left join own using (guide) left join ntf using (category, subcategory, details))
select guide, category, subcategory, details, cast(n as bigint) as n, round(fraction, 6) as fraction, round(case when fraction is null then null when fraction = 0 and base = 0 then 5.0 when fraction = 0 then -5.0 when base = 0 then 'inf'::double else log2(fraction / base) end, 6) as log2_fc from whole"""
)
def log2_fold_changes(spark, folder):
    cnt = facts.counts(spark, folder)
    out = N.log2_fold_changes(cnt, facts.guides(spark, folder).select("guide"), cnt.select(*OUTCOME).distinct())
    return out.select("guide", *OUTCOME, "n", r6("fraction").alias("fraction"), r6("log2_fc").alias("log2_fc"))


@query(
    """, per as (select guide, is_nt, sum(case when category = 'deletion' then n else 0 end) as n, sum(n) as total from cnt group by all),
b as (select sum(n) / sum(total) as base from per where is_nt),
f as (select lib.guide, coalesce(per.n, 0) / nullif(per.total, 0) as fraction from lib left join per on per.guide = lib.guide)
select guide, round(fraction, 6) as fraction, round(case when fraction is null then null when fraction = 0 and base = 0 then 5.0 when fraction = 0 then -5.0 when base = 0 then 'inf'::double else log2(fraction / base) end, 6) as log2_fc from f, b"""
)
def log2_fc_outcome_set(spark, folder):
    out = N.outcome_set_fold_change(facts.counts(spark, folder), facts.guides(spark, folder).select("guide"), F.col("category") == "deletion")
    return out.select("guide", r6("fraction").alias("fraction"), r6("log2_fc").alias("log2_fc"))


@query(
    """, pc as (select pool, guide, gene, is_nt, count(*) as total, count(*) filter (category = 'deletion') as n from gr where perfect group by all),
b as (select pool, sum(n) / nullif(sum(total), 0) as base from pc where is_nt group by pool),
grid as (select p.pool, lib.guide, lib.is_nt from (select distinct pool from pc) p cross join lib),
f as (select grid.*, coalesce(pc.n, 0) as n, coalesce(pc.n, 0) / nullif(pc.total, 0) as fraction, coalesce(b.base, 0) as base from grid left join pc on pc.pool = grid.pool and pc.guide = grid.guide left join b on b.pool = grid.pool),
l as (select *, case when fraction is null then null when fraction = 0 and base = 0 then 5.0 when fraction = 0 then -5.0 when base = 0 then 'inf'::double else log2(fraction / base) end as log2_fc from f),
m as (select guide, avg(log2_fc) as row_mean from l where log2_fc is not null and not isinf(log2_fc) group by guide)
select l.pool as fixed, l.guide as variable, cast(l.n as bigint) as n, round(l.log2_fc, 6) as log2_fc, round(l.log2_fc - m.row_mean, 6) as centred from l left join m on l.guide = m.guide"""
)
def doubles_log2_fc(spark, folder):
    """Fixed part (here the site) by variable guide, each fixed part with its own baseline, and centred by guide."""
    rows = facts.guided(spark, folder).filter("perfect").groupBy("pool", "guide", "is_nt").agg(F.count("*").alias("total"), F.sum((F.col("category") == "deletion").cast("long")).alias("n"))
    pc = materialize(rows, "doubles")
    base = pc.filter("is_nt").groupBy("pool").agg(safe_ratio(F.sum("n"), F.sum("total")).alias("base"))
    dense = C.densify(pc.select("pool").distinct(), facts.guides(spark, folder).select("guide"), pc.drop("is_nt"), ["pool", "guide"], {"n": 0}).join(base, "pool", "left")
    fold = dense.withColumn("log2_fc", log2_fold_change(safe_ratio(F.col("n"), F.col("total")), F.coalesce("base", F.lit(0.0))))
    finite = fold.filter(F.col("log2_fc").isNotNull() & ~F.col("log2_fc").isin(float("inf"), float("-inf"))).groupBy("guide").agg(F.avg("log2_fc").alias("row_mean"))
    return fold.join(finite, "guide", "left").select(F.col("pool").alias("fixed"), F.col("guide").alias("variable"), "n", r6("log2_fc").alias("log2_fc"), r6(F.col("log2_fc") - F.col("row_mean")).alias("centred"))


_CATS = """, labelled as (select guide, category, subcategory, n from cnt where category <> 'malformed layout' union all select 'all_non_targeting', category, subcategory, n from cnt where is_nt and category <> 'malformed layout'),
cat as (select guide, category, sum(n) as n from labelled group by all)
"""


@query(_CATS + "select guide, category, subcategory, cast(sum(n) as bigint) as n from labelled group by grouping sets ((guide, category, subcategory), (guide, category))")
def category_counts_rollup(spark, folder):
    return C.category_counts(facts.counts(spark, folder))


def _category_fractions(spark, folder):
    cats = C.category_counts(facts.counts(spark, folder)).filter("subcategory is null").drop("subcategory")
    shares = materialize(C.share_of_total(cats, "n", "fraction", ["guide"]), "category-fractions")
    base = shares.filter(F.col("guide") == C.ALL_NON_TARGETING).select("category", F.col("fraction").alias("nt_fraction"))
    labels = shares.select("guide").distinct()
    dense = C.densify(labels, base, shares.select("guide", "category", "fraction"), ["guide", "category"], {"fraction": 0.0})
    return dense.withColumn("difference", F.col("fraction") - F.col("nt_fraction")).withColumn("log2_fc", log2_or_null(safe_ratio(F.col("fraction"), F.col("nt_fraction"))))


_CATF = _CATS + """, sh as (select guide, category, n / sum(n) over (partition by guide) as fraction from cat),
base as (select category, fraction as nt_fraction from sh where guide = 'all_non_targeting'),
catf as (select g.guide, base.category, coalesce(sh.fraction, 0) as fraction, base.nt_fraction from (select distinct guide from sh) g cross join base left join sh on sh.guide = g.guide and sh.category = base.category)
"""


@query(_CATF + "select guide, category, round(fraction, 6) as fraction, round(fraction - nt_fraction, 6) as difference from catf")
def category_fractions(spark, folder):
    return _category_fractions(spark, folder).select("guide", "category", r6("fraction").alias("fraction"), r6("difference").alias("difference"))


@query(_CATF + "select guide, category, round(log2(nullif(fraction / nt_fraction, 0)), 6) as log2_fc from catf")
def category_log2_fc(spark, folder):
    return _category_fractions(spark, folder).select("guide", "category", r6("log2_fc").alias("log2_fc"))


@query(
    """, g as (select guide, case when category in ('deletion', 'insertion', 'wild type') then category else 'all others' end as category, sum(n) as n from cnt where category not in ('uncategorized', 'malformed layout', 'bad sequence') group by all)
select guide, category, cast(n as bigint) as n, round(n / sum(n) over (partition by guide), 6) as fraction from g"""
)
def category_grouped(spark, folder):
    return N.grouped_categories(facts.counts(spark, folder), ["deletion", "insertion", "wild type"]).withColumn("fraction", r6("fraction"))


@query(_CATS + ", c as (select category, n, n / sum(n) over () as f from cat where guide = 'all_non_targeting') select category, row_number() over (order by f desc, category) as place, round(f, 6) as fraction from c")
def categories_by_baseline(spark, folder):
    cats = C.category_counts(facts.counts(spark, folder)).filter((F.col("guide") == C.ALL_NON_TARGETING) & F.col("subcategory").isNull())
    shares = C.share_of_total(cats, "n", "fraction")
    return shares.select("category", F.row_number().over(Window.orderBy(F.desc("fraction"), "category")).alias("place"), r6("fraction").alias("fraction"))


@query(
    """, j as (select cnt.guide, case when top.category is null then 'uncommon' else cnt.category end as category, case when top.category is null then 'uncommon' else cnt.subcategory end as subcategory,
  case when top.category is null then 'collapsed' else cnt.details end as details, cnt.n from cnt left join top on cnt.category = top.category and cnt.subcategory = top.subcategory and cnt.details = top.details)
select guide, category, subcategory, details, cast(sum(n) as bigint) as n from j group by all"""
)
def common_counts_leftover(spark, folder):
    cnt = facts.counts(spark, folder)
    return C.with_leftover(cnt, facts.frequent(cnt), ["guide"])


@query("select category, subcategory, details, round(nt_fraction, 6) as nt_fraction from ntf where nt_fraction >= 0.01 and category <> 'uncategorized'")
def outcomes_above_threshold(spark, folder):
    return N.baseline(facts.counts(spark, folder)).filter((F.col("nt_fraction") >= 0.01) & (F.col("category") != "uncategorized")).select(*OUTCOME, r6("nt_fraction").alias("nt_fraction"))


@query(", q as (select 1 / quantile_cont(total, 0.99) as least from own) select category, subcategory, details, round(nt_fraction, 6) as nt_fraction from ntf, q where nt_fraction >= least and category <> 'uncategorized'")
def canonical_outcomes(spark, folder):
    """Outcomes of which a guide at the 0.99 quantile of sizes has one record to be expected."""
    cnt = facts.counts(spark, folder)
    least = N.expected_in_quantile(C.totals(cnt, ["guide"]), 1, 0.99)
    return N.baseline(cnt).filter((F.col("nt_fraction") >= F.lit(least)) & (F.col("category") != "uncategorized")).select(*OUTCOME, r6("nt_fraction").alias("nt_fraction"))


@query("select category, subcategory, details, cast(nt_n as bigint) as nt_n from top")
def most_frequent_outcomes(spark, folder):
    return facts.frequent(facts.counts(spark, folder))


_CHI = f""", act as (select category, subcategory, details from top order by nt_n desc, category, subcategory, details limit {facts.FREQUENT_OUTCOMES}),
sel as (select dense.* from dense join act using (category, subcategory, details) where not (category = 'wild type' and subcategory = 'clean' and details = 'n/a')),
tot as (select guide, sum(n) as total from sel group by guide having sum(n) > 0),
e as (select category, subcategory, details, sum(n) as nt_n from sel where is_nt group by all),
et as (select sum(nt_n) as s from e),
chi as (select sel.guide, sum(case when e.nt_n > 0 then pow(sel.n - e.nt_n / et.s * tot.total, 2) / (e.nt_n / et.s * tot.total) when sel.n = 0 then 0 else 'inf'::double end) as chi_squared
  from sel join tot on tot.guide = sel.guide join e on e.category = sel.category and e.subcategory = sel.subcategory and e.details = sel.details, et group by sel.guide)
"""


def _chi(spark, folder):
    cnt = facts.counts(spark, folder)
    return S.chi_squared(cnt, facts.guides(spark, folder), facts.frequent(cnt, facts.FREQUENT_OUTCOMES))


@query(_CHI + "select guide, round(chi_squared, 6) as chi_squared from chi")
def chi_squared_per_guide(spark, folder):
    return _chi(spark, folder).withColumn("chi_squared", F.round("chi_squared", 6))


@query(_CHI + "select c.guide, l.gene, round(c.chi_squared, 6) as chi_squared from chi c join lib l on l.guide = c.guide where chi_squared > 0.5 * (select max(chi_squared) from chi join lib on lib.guide = chi.guide where lib.is_nt)")
def active_guides(spark, folder):
    return S.active_guides(materialize(_chi(spark, folder), "chi"), facts.guides(spark, folder), 0.5).select("guide", "gene", F.round("chi_squared", 6).alias("chi_squared"))


@query(_CHI + "select guide, round(chi_squared, 6) as chi_squared from chi order by round(chi_squared, 6) desc, guide limit 50")
def top_active_guides(spark, folder):
    return _chi(spark, folder).orderBy(F.round("chi_squared", 6).desc(), "guide").limit(50).withColumn("chi_squared", F.round("chi_squared", 6))


@query(_CHI + "select l.gene, c.guide, row_number() over (partition by l.gene order by round(c.chi_squared, 6) desc, c.guide) as activity_rank from chi c join lib l on l.guide = c.guide")
def gene_guides_by_activity(spark, folder):
    return S.guides_by_activity(_chi(spark, folder), facts.guides(spark, folder)).select("gene", "guide", "activity_rank")


_GS = """, per as (select guide, sum(case when category = 'deletion' then n else 0 end) as num, sum(n) as den from cnt group by guide),
g0 as (select lib.*, coalesce(per.num, 0) as numerator, coalesce(per.den, 0) as denominator from lib left join per on per.guide = lib.guide),
b as (select sum(numerator) / sum(denominator) as base from g0 where is_nt),
gs as (select guide, gene, is_nt, is_best_promoter, cast(numerator as bigint) as numerator, cast(denominator as bigint) as denominator, numerator / nullif(denominator, 0) as frequency, base as nt_fraction,
  case when denominator = 0 then null when base = 0 and numerator = 0 then null when base = 0 then 5.0 when numerator = 0 then -5.0 else greatest(-5.0, least(5.0, log2(numerator / denominator / base))) end as log2_fc from g0, b)
"""


def _guide_stats(spark, folder):
    parts = S.numerator_and_denominator(facts.counts(spark, folder), F.col("category") == "deletion")
    return materialize(S.guide_statistics(parts, facts.guides(spark, folder)), "guide-statistics")


@query(_GS + "select guide, gene, is_nt, is_best_promoter, numerator, denominator, round(frequency, 6) as frequency, round(nt_fraction, 6) as nt_fraction, round(log2_fc, 6) as log2_fc from gs")
def guide_statistics(spark, folder):
    return _guide_stats(spark, folder).select("guide", "gene", "is_nt", "is_best_promoter", "numerator", "denominator", *[r6(c).alias(c) for c in ("frequency", "nt_fraction", "log2_fc")])


def _depths(source: str, by: str, value: str = "log2_fc", best: str = "where is_best_promoter and log2_fc is not null") -> str:
    aggs = ", ".join(f"round(avg({value}) filter ({k[0]} <= {n}), 6) as {k}_{n}" for k in ("lowest", "highest", "extreme") for n in (1, 2, 3))
    return f"""select {by}, {aggs} from (select *, row_number() over (partition by {by} order by {value}, guide) as l, row_number() over (partition by {by} order by {value} desc, guide) as h,
  row_number() over (partition by {by} order by abs({value}) desc, guide) as e from {source} {best}) group by {by}"""


@query(_GS + _depths("gs", "gene"))
def gene_statistics(spark, folder):
    out = S.gene_statistics(_guide_stats(spark, folder))
    return out.select("gene", *[r6(c).alias(c) for c in out.columns if c != "gene"])


@query(
    """, per as (select guide, category, sum(n) as num from cnt group by all), cats as (select distinct category from cnt),
g0 as (select lib.*, c.category, coalesce(per.num, 0) as numerator, own.total as denominator from lib cross join cats c left join per on per.guide = lib.guide and per.category = c.category left join own on own.guide = lib.guide),
b as (select category, sum(numerator) / sum(denominator) as base from g0 where is_nt group by category),
gs as (select g0.guide, gene, g0.category, is_best_promoter, case when denominator is null then null when base = 0 and numerator = 0 then null when base = 0 then 5.0 when numerator = 0 then -5.0 else greatest(-5.0, least(5.0, log2(numerator / denominator / base))) end as log2_fc from g0 join b on b.category = g0.category)
"""
    + _depths("gs", "category, gene")
)
def gene_category_statistics(spark, folder):
    cnt = facts.counts(spark, folder)
    per = cnt.groupBy("guide", "category").agg(F.sum("n").alias("numerator"))
    dense = C.densify(facts.guides(spark, folder).select("guide", "gene", "is_nt", "is_best_promoter"), cnt.select("category").distinct(), per, ["guide", "category"], {"numerator": 0}).join(C.totals(cnt, ["guide"], "denominator"), "guide", "left")
    base = dense.filter("is_nt").groupBy("category").agg(safe_ratio(F.sum("numerator"), F.sum("denominator")).alias("base"))
    rows = dense.join(base, "category").withColumn("log2_fc", F.when(F.col("denominator").isNotNull(), clamped_log2(safe_ratio(F.col("numerator"), F.col("denominator")), F.col("base"))))
    out = S.gene_statistics(rows, by=["category"])
    return out.select("category", "gene", *[r6(c).alias(c) for c in out.columns if c not in ("gene", "category")])


@query(_GS + """select gene, round(avg(log2_fc) filter (u <= 2), 6) as up_fc, round(avg(log2_fc) filter (d <= 2), 6) as down_fc, count(*) as n_guides from
  (select *, row_number() over (partition by gene order by log2_fc desc, guide) as u, row_number() over (partition by gene order by log2_fc, guide) as d from gs where log2_fc is not null) group by gene""")
def gene_up_down_fc(spark, folder):
    return S.gene_fold_changes(_guide_stats(spark, folder)).select("gene", r6("up_fc").alias("up_fc"), r6("down_fc").alias("down_fc"), "n_guides")


_TAILS = _GS + """, tails as (
  select guide, gene, coalesce(sum(p) filter (i <= numerator), 0) as p_down, coalesce(sum(p) filter (i >= numerator), 0) as p_up from (
    select guide, gene, numerator, i, exp(lgamma(denominator + 1) - lgamma(i + 1) - lgamma(denominator - i + 1) + i * ln(nt_fraction) + (denominator - i) * ln(1 - nt_fraction)) as p
    from gs, unnest(range(0, denominator + 1)) as t(i)) group by guide, gene, numerator)
"""


@query(_TAILS + "select guide, gene, round(p_down, 6) as p_down, round(p_up, 6) as p_up from tails")
def binomial_guide_pvalues(spark, folder):
    return S.binomial_p_values(_guide_stats(spark, folder)).select("guide", "gene", r6("p_down").alias("p_down"), r6("p_up").alias("p_up"))


_KN = """, ranked as (select guide, gene, {p} as p, row_number() over (partition by gene order by {p}, guide) as k, count(*) over (partition by gene) as n from {src}),
ch as (select gene, n, k, p, (select sum(exp(lgamma(n + 1) - lgamma(f + 1) - lgamma(n - f + 1)) * pow(1 - p, f) * pow(p, n - f)) from unnest(range(0, n - k + 1)) as t(f)) as chance from ranked where k <= 9),
gp as (select gene, n as n_guides, arg_min(k, (round(chance, 12), k)) as best_k, least(1.0, min(chance) * least(9, n)) as p from ch group by gene, n)
"""


@query(_GS + _KN.format(p="least(1.0, numerator / denominator)", src="gs where denominator > 0 and not is_nt") + "select gene, n_guides, round(p, 6) as p from gp")
def k_of_n_pvalues(spark, folder):
    """The combination on shares, which lie in [0, 1] as p values do."""
    rows = _guide_stats(spark, folder).filter("denominator > 0 and not is_nt").withColumn("share", F.col("numerator") / F.col("denominator"))
    return S.gene_p_values(rows, "share").select("gene", F.col("n_guides").cast("long").alias("n_guides"), r6("p").alias("p"))


@query()
def gene_significance(spark, folder):
    """Both directions combined per gene, the relevant one and fold changes."""
    stats = materialize(S.binomial_p_values(_guide_stats(spark, folder)), "p-values")
    return S.gene_directions(stats).join(S.gene_fold_changes(stats), "gene")


@query()
def clopper_pearson(spark, folder):
    return S.with_intervals(_guide_stats(spark, folder)).select("guide", "numerator", "denominator", "interval_low", "interval_high", "log2_low", "log2_high")


@query()
def beta_binomial(spark, folder):
    return S.beta_binomial_p_values(_guide_stats(spark, folder))


@query()
def beta_binomial_genes(spark, folder):
    rows = S.beta_binomial_p_values(_guide_stats(spark, folder)).filter("not is_nt")
    return S.gene_directions(materialize(rows, "beta-binomial"))


@query(_TAILS + "select t.guide, case when frequency >= nt_fraction then 'up' else 'down' end as direction, round(case when frequency >= nt_fraction then p_up else p_down end, 6) as p from tails t join gs on gs.guide = t.guide where denominator > 0")
def significance_band(spark, folder):
    return S.significance_flags(_guide_stats(spark, folder).filter("denominator > 0")).select("guide", "direction", r6("p").alias("p"))


@query()
def guide_outcome_table(spark, folder):
    """Per guide and frequent outcome: fractions, capped fold change, exact interval, and whether it leaves out the baseline."""
    cnt = facts.counts(spark, folder)
    rows = N.log2_fold_changes(cnt, facts.guides(spark, folder).select("guide"), facts.frequent(cnt)).filter("total > 0")
    capped = F.when(F.col("n") == 0, F.lit(-6.0)).when(F.col("nt_fraction") == 0, F.lit(6.0)).otherwise(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), F.log2(safe_ratio(F.col("fraction"), F.nullif(F.col("nt_fraction"), F.lit(0.0)))))))
    out = S.with_intervals(rows.withColumn("log2_capped", capped), "n", "total")
    outside = (F.col("nt_fraction") < F.col("interval_low")) | (F.col("nt_fraction") > F.col("interval_high"))
    return out.withColumn("is_significant", outside).withColumn("direction", F.when(F.col("fraction") >= F.col("nt_fraction"), "up").otherwise("down")).select("guide", *OUTCOME, "n", "total", "fraction", "nt_fraction", "log2_capped", "interval_low", "interval_high", "is_significant", "direction")


@query(_GS + "(select guide, round(log2_fc, 6) as log2_fc, 'top' as \"end\" from gs where log2_fc is not null order by log2_fc desc, guide limit 20) union all (select guide, round(log2_fc, 6), 'bottom' from gs where log2_fc is not null order by log2_fc, guide limit 20)")
def guide_extremes(spark, folder):
    stats = _guide_stats(spark, folder).filter("log2_fc is not null")
    return S.extremes(stats.select("guide", "log2_fc"), "log2_fc", "guide", 20, 20).withColumn("log2_fc", r6("log2_fc"))


@query(_GS + """, o as (select gene, row_number() over (order by log2_fc, guide) - 1 as i from gs where log2_fc is not null), x as (select gene, i, i - row_number() over (partition by gene order by i) as g from o)
select gene, min(i) as first, max(i) as last from x group by gene, g""")
def ranked_gene_blocks(spark, folder):
    stats = _guide_stats(spark, folder).filter("log2_fc is not null").select("gene", "log2_fc", "guide")
    return S.blocks(stats, "gene", [F.asc("log2_fc"), F.asc("guide")]).select("gene", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(_GS + "select gene, round(max(abs(log2_fc)), 6) as largest from gs where not is_nt group by gene having max(abs(log2_fc)) is not null order by max(abs(log2_fc)) desc, gene limit 25")
def genes_by_largest_effect(spark, folder):
    rows = _guide_stats(spark, folder).filter("not is_nt").groupBy("gene").agg(F.max(F.abs(F.col("log2_fc"))).alias("largest")).filter("largest is not null")
    return rows.orderBy(F.desc("largest"), "gene").limit(25).withColumn("largest", r6("largest"))


@query("select guide, category, subcategory, details, h as place_high, l as place_low from (select *, row_number() over (partition by guide order by log2_fc desc, category, subcategory, details) as h, row_number() over (partition by guide order by log2_fc, category, subcategory, details) as l from fc where log2_fc is not null) where h <= 5 or l <= 5")
def most_changed_outcomes(spark, folder):
    cnt = facts.counts(spark, folder)
    rows = N.log2_fold_changes(cnt, facts.guides(spark, folder).select("guide"), facts.frequent(cnt)).filter("log2_fc is not null")
    rows = C.ranked(C.ranked(rows, ["guide"], [F.desc("log2_fc"), *OUTCOME], "place_high"), ["guide"], [F.asc("log2_fc"), *OUTCOME], "place_low")
    return rows.filter("place_high <= 5 or place_low <= 5").select("guide", *OUTCOME, F.col("place_high").cast("long").alias("place_high"), F.col("place_low").cast("long").alias("place_low"))


@query("select lib.gene, category, subcategory, details, round(avg(log2_fc), 6) as mean_log2_fc from fc join lib using (guide) where log2_fc is not null and not isinf(log2_fc) group by lib.gene, category, subcategory, details".replace("lib.gene", "fc.gene").replace(" join lib using (guide)", ""))
def outcomes_by_gene_phenotype(spark, folder):
    cnt = facts.counts(spark, folder)
    rows = N.log2_fold_changes(cnt, facts.guides(spark, folder).select("guide", "gene"), facts.frequent(cnt))
    rows = rows.filter(F.col("log2_fc").isNotNull() & ~F.col("log2_fc").isin(float("inf"), float("-inf")))
    return rows.groupBy("gene", *OUTCOME).agg(r6(F.avg("log2_fc")).alias("mean_log2_fc"))


@query("select guide, category, subcategory, details, round(log10(greatest(fraction, 0.5 / total)), 6) as log10_floor, round(log10(greatest(fraction, 1e-5)), 6) as log10_fixed from dense where total > 0")
def frequency_floors(spark, folder):
    cnt = facts.counts(spark, folder)
    rows = N.dense_fractions(cnt, facts.guides(spark, folder).select("guide"), facts.frequent(cnt)).filter("total > 0")
    return rows.select("guide", *OUTCOME, r6(F.log10(F.greatest(F.col("fraction"), F.lit(0.5) / F.col("total")))).alias("log10_floor"), r6(log10_floor(F.col("fraction"), 1e-5)).alias("log10_fixed"))


@query("select category, subcategory, details, round(stddev_samp(fraction), 6) as nt_std, round(avg(fraction), 6) as nt_mean from dense where is_nt and total > 0 group by category, subcategory, details")
def nt_spread(spark, folder):
    cnt = facts.counts(spark, folder)
    rows = N.dense_fractions(cnt, facts.guides(spark, folder).filter("is_nt").select("guide"), facts.frequent(cnt)).filter("total > 0")
    return rows.groupBy(*OUTCOME).agg(r6(F.stddev_samp("fraction")).alias("nt_std"), r6(F.avg("fraction")).alias("nt_mean"))


@query()
def high_frequency_bundle(spark, folder):
    """Counts, fractions, fold changes and intervals of the frequent outcomes, as one table."""
    cnt = facts.counts(spark, folder)
    rows = N.log2_fold_changes(cnt, facts.guides(spark, folder).select("guide"), facts.frequent(cnt)).filter("total > 0")
    return S.with_intervals(rows, "n", "total").select("guide", *OUTCOME, "n", "total", "fraction", "nt_fraction", "log2_fc", "interval_low", "interval_high")


@query(
    """, pc as (select pool, guide, is_nt, gene, category, count(*) as n from gr where perfect group by all), t as (select pool, guide, sum(n) as den from pc group by all), sets as (select distinct pool, category from pc),
g as (select s.pool, s.category, lib.guide, lib.gene, lib.is_nt, coalesce(pc.n, 0) as num, t.den from sets s cross join lib join t on t.pool = s.pool and t.guide = lib.guide left join pc on pc.pool = s.pool and pc.guide = lib.guide and pc.category = s.category),
b as (select pool, category, sum(num) / sum(den) as base from g where is_nt group by all)
select g.pool, g.category as outcome_set, guide, gene, cast(num as bigint) as numerator, cast(den as bigint) as denominator, round(case when base = 0 and num = 0 then null when base = 0 then 5.0 when num = 0 then -5.0 else greatest(-5.0, least(5.0, log2(num / den / base))) end, 6) as log2_fc
from g join b on b.pool = g.pool and b.category = g.category"""
)
def screen_table_long(spark, folder):
    """Guide statistics of every pool and outcome set in one table."""
    pc = materialize(facts.guided(spark, folder).filter("perfect").groupBy("pool", "guide", "category").agg(F.count("*").alias("n")), "pool-counts")
    t = pc.groupBy("pool", "guide").agg(F.sum("n").alias("denominator")).join(facts.guides(spark, folder).select("guide", "gene", "is_nt"), "guide")
    grid = pc.select("pool", "category").distinct().join(t, "pool")
    g = grid.join(pc, ["pool", "guide", "category"], "left").withColumn("numerator", F.coalesce("n", F.lit(0)))
    b = g.filter("is_nt").groupBy("pool", "category").agg(safe_ratio(F.sum("numerator"), F.sum("denominator")).alias("base"))
    out = g.join(b, ["pool", "category"]).withColumn("log2_fc", clamped_log2(safe_ratio(F.col("numerator"), F.col("denominator")), F.col("base")))
    return out.select("pool", F.col("category").alias("outcome_set"), "guide", "gene", "numerator", "denominator", r6("log2_fc").alias("log2_fc"))


@query(
    """, o as (select distinct category, subcategory, details, case category when 'wild type' then 0 when 'donor' then 1 when 'insertion' then 2 when 'deletion' then 3 when 'deletion + insertion' then 4 when 'duplication' then 5 when 'genomic insertion' then 7
  when 'donor misintegration' then 8 when 'uncategorized' then 6 else 9 end as grp, coalesce(try_cast(regexp_extract(details, 'D:(\\d+),(\\d+)', 2) as int), 0) as len from top)
select category, subcategory, details, grp, row_number() over (order by grp, len, category, subcategory, details) as place from o"""
)
def rational_outcome_order(spark, folder):
    order = ["wild type", "donor", "insertion", "deletion", "deletion + insertion", "duplication", "uncategorized", "genomic insertion", "donor misintegration"]
    group = F.coalesce(*[F.when(F.col("category") == name, F.lit(i)) for i, name in enumerate(order)], F.lit(len(order)))
    rows = facts.frequent(facts.counts(spark, folder)).withColumn("grp", group).withColumn("len", F.coalesce(deletion_length(F.col("details")), F.lit(0)))
    return rows.select(*OUTCOME, "grp", F.row_number().over(Window.orderBy("grp", "len", *OUTCOME)).cast("long").alias("place"))


@query(_GS + """, s as (select guide, denominator, frequency, log2_fc, row_number() over (partition by log2_fc >= 0 order by case when log2_fc >= 0 then -frequency else frequency end, guide) as r from gs where log2_fc is not null and frequency between 0.05 and 0.95)
select guide, round(frequency, 6) as frequency, log2_fc >= 0 as is_up from s where r <= 10""")
def scatter_selection(spark, folder):
    rows = _guide_stats(spark, folder).filter("log2_fc is not null and frequency between 0.05 and 0.95").withColumn("is_up", F.col("log2_fc") >= 0)
    rows = C.ranked(rows, ["is_up"], [F.when(F.col("is_up"), -F.col("frequency")).otherwise(F.col("frequency")), F.col("guide")], "r").filter("r <= 10")
    return rows.select("guide", r6("frequency").alias("frequency"), "is_up")


@query(_GS + "select (select arg_max(guide, (denominator, guide)) from gs where is_nt) as largest_control, (select median(denominator) from gs) as median_umis")
def control_and_median(spark, folder):
    return _guide_stats(spark, folder).agg(F.max(F.when(F.col("is_nt"), F.struct("denominator", "guide")))["guide"].alias("largest_control"), F.median("denominator").alias("median_umis"))


#: Draws of each size in the registered query; the operator takes any number, README has the time of the whole job.
NULL_DRAWS = 1_000


@query()
def null_quantiles(spark, folder):
    """Quantiles of the counts of every outcome and group in draws of control records, for each of 95 sizes."""
    group = F.when((F.col("category") == "deletion") | ((F.col("category") == "indel") & (F.col("subcategory") == "deletion")), "deletion")
    group = group.when((F.col("category") == "insertion") | ((F.col("category") == "indel") & (F.col("subcategory") == "insertion")), "insertion")
    group = group.when((F.col("category") == "no indel") & (F.col("subcategory") == "other"), "partial_donor")
    rows = facts.guided(spark, folder).filter("perfect and is_nt").select("guide", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in OUTCOME]).alias("outcome"), group.alias("group"))
    frequencies = materialize(S.null_frequencies(rows, S.NULL_CELLS, NULL_DRAWS), "nulls")
    return S.null_grid_quantiles(frequencies, S.NULL_CELLS, NULL_DRAWS)
