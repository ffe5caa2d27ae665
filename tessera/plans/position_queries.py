"""Queries on positions and lengths along the target."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.functions import outcomes as O
from tessera.functions.ratios import log2_or_null, safe_ratio
from tessera.operators import counts as C
from tessera.operators import intervals as I
from tessera.plans import facts
from tessera.plans.facts import SQL
from tessera.session import materialize

CUT = 110
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


_DEL = rf""", del as (select guide, is_nt, n, regexp_extract(details, '(?:^|;)D:(\d+),(\d+)', 1) as s, regexp_extract(details, '(?:^|;)D:(\d+),(\d+)', 2) as l from cnt),
iv as (select guide, is_nt, n, s::int as start, l::int as length, s::int + l::int - 1 as stop from del where s <> '' and l::int > 0),
target as (select greatest({2 * CUT}, coalesce(max(stop), 0)) as last from iv), place as (select unnest(range(0, last + 1)) as position from target)
"""


def _intervals(spark, folder):
    return I.deletion_intervals(facts.counts(spark, folder))


def _last(intervals) -> int:
    """The last position of the target: no deletion reaches beyond."""
    return max(2 * CUT, intervals.agg(F.max("stop")).first()[0] or 0)


@query(_DEL + ", g as (select lib.guide, position from lib cross join place) select g.guide, cast(g.position as int) as position, cast(coalesce(sum(iv.n), 0) as bigint) as covered from g left join iv on iv.guide = g.guide and iv.start <= g.position and iv.stop >= g.position group by all")
def coverage_profile(spark, folder):
    rows = _intervals(spark, folder)
    return I.dense_coverage(rows, ["guide"], "start", "stop", "n", 0, _last(rows), facts.guides(spark, folder))


@query(
    _DEL
    + """, ch as (select pos, sum(d) as d, sum(s) as starts, sum(e) as stops from (select start as pos, n as d, n as s, 0 as e from iv where is_nt union all select stop + 1, -n, 0, 0 from iv where is_nt union all select stop, 0, 0, n from iv where is_nt) group by pos)
select pos as position, cast(starts as bigint) as starts, cast(stops as bigint) as stops, cast(sum(d) over (order by pos rows unbounded preceding) as bigint) as covered from ch"""
)
def boundary_profile(spark, folder):
    rows = _intervals(spark, folder).filter("is_nt").withColumn("all", F.lit(1))
    return I.coverage(rows, ["all"], "start", "stop", "n").select("position", "starts", "stops", "covered")


@query(_DEL + "select guide, edge, position, cast(sum(n) as bigint) as n from (select guide, 'start' as edge, start as position, n from iv union all select guide, 'end', stop, n from iv) group by all")
def deletion_edges(spark, folder):
    return I.edges(_intervals(spark, folder), ["guide"], "n")


@query(
    _DEL
    + """, c as (select g.guide, place.position, coalesce(sum(iv.n), 0) as covered from (select guide from lib) g cross join place left join iv on iv.guide = g.guide and iv.start <= place.position and iv.stop >= place.position group by all),
f as (select c.guide, c.position, covered / nullif(own.total, 0) as fraction from c left join own on own.guide = c.guide),
b as (select c.position, sum(covered) / (select sum(total) from own join lib using (guide) where is_nt) as base from c join lib on lib.guide = c.guide where lib.is_nt group by c.position)
select f.guide, cast(f.position as int) as position, round(log2(nullif(fraction / nullif(base, 0), 0)), 6) as log2_fc from f join b on b.position = f.position"""
)
def fraction_removed_log2_fc(spark, folder):
    cnt = facts.counts(spark, folder)
    guides = facts.guides(spark, folder).select("guide", "is_nt")
    own = C.totals(cnt, ["guide"])
    removed = I.deletion_intervals(cnt)
    cover = I.dense_coverage(removed, ["guide"], "start", "stop", "n", 0, _last(removed), guides).join(guides, "guide").join(own, "guide", "left")
    nt_total = own.join(guides.filter("is_nt"), "guide", "left_semi").agg(F.sum("total")).first()[0]
    base = cover.filter("is_nt").groupBy("position").agg((F.sum("covered") / F.lit(nt_total)).alias("base"))
    rows = cover.join(base, "position").withColumn("fraction", safe_ratio(F.col("covered"), F.col("total")))
    return rows.select("guide", "position", r6(log2_or_null(safe_ratio(F.col("fraction"), F.col("base")))).alias("log2_fc"))


_GRID = _DEL + f""", lr as (select is_nt, n, greatest(0, least(stop, {CUT}) - start + 1) as l, greatest(0, stop - greatest(start - 1, {CUT})) as r from iv),
cells as (select is_nt, l, r, sum(n) as n from lr where l <= 30 and r <= 30 group by all)
"""


@query(_GRID + "select g.is_nt, cast(a as int) as left, cast(b as int) as right, cast(coalesce(n, 0) as bigint) as n from (values (true), (false)) as g(is_nt), unnest(range(0, 31)) as x(a), unnest(range(0, 31)) as y(b) left join cells on cells.is_nt = g.is_nt and l = a and r = b".replace(" as left,", ' as "left",').replace(" as right,", ' as "right",').replace(", unnest(range(0, 31)) as x(a), unnest(range(0, 31)) as y(b)", " cross join unnest(range(0, 31)) as x(a) cross join unnest(range(0, 31)) as y(b)"))
def deletion_grid(spark, folder):
    rows = _intervals(spark, folder)
    labels = rows.select("is_nt").distinct()
    return I.deletion_grid(rows, ["is_nt"], CUT, 30, "n", labels)


@query(_DEL + f", g as (select guide, n, greatest(0, least(stop, {CUT}) - start + 1) as l, greatest(0, stop - greatest(start - 1, {CUT})) as r from iv) select guide, case when l > 0 and r > 0 then 'bidirectional' when l > 0 then 'left' when r > 0 then 'right' end as direction, cast(sum(n) as bigint) as n from g group by all")
def deletion_directions(spark, folder):
    rows = _intervals(spark, folder).withColumn("direction", O.directionality(F.col("start"), F.col("length"), CUT))
    return rows.groupBy("guide", "direction").agg(F.sum("n").alias("n"))


@query(_DEL + ", f as (select * from (values ('primer_left', 0, 94), ('window', 105, 115), ('primer_right', 140, 216)) as t(feature, a, b)) select feature, start <= b and stop >= a and start >= a and stop <= b as inside, cast(sum(n) as bigint) as n from iv join f on start <= b and stop >= a group by all")
def feature_overlaps(spark, folder):
    features = spark.createDataFrame([("primer_left", 0, 94), ("window", 105, 115), ("primer_right", 140, 216)], "feature string, f_start int, f_stop int")
    return I.overlaps(_intervals(spark, folder), features).groupBy("feature", "inside").agg(F.sum("n").alias("n"))


_LEN = """, v as (select pool, inferred_amplicon_length as value, count(*) as n from gr where inferred_amplicon_length is not null group by all), ends as (select pool, min(value) as a, max(value) as b from v group by pool),
grid as (select pool, unnest(range(a, b + 1)) as value from ends), h as (select grid.pool, cast(grid.value as int) as value, coalesce(v.n, 0) as n from grid left join v on v.pool = grid.pool and v.value = grid.value)
"""


@query(_LEN + "select * from h")
def length_distribution_densified(spark, folder):
    return I.dense_histogram(facts.guided(spark, folder), ["pool"], "inferred_amplicon_length")


@query(_LEN + ", f as (select pool, value, n / sum(n) over (partition by pool) as fraction from h) select pool, value, round(avg(fraction) over (partition by pool order by value rows between 10 preceding and 10 following), 6) as smooth from f")
def smoothed_length_fractions(spark, folder):
    shares = C.share_of_total(I.dense_histogram(facts.guided(spark, folder), ["pool"], "inferred_amplicon_length"), "n", "fraction", ["pool"])
    return I.smoothed(shares, ["pool"], "value", "fraction").select("pool", "value", r6("smooth").alias("smooth"))


@query("select category, subcategory, case when inferred_amplicon_length is null or inferred_amplicon_length < 0 then 1050 else least(inferred_amplicon_length, 1000) end as length, count(*) as n from gr group by all")
def outcome_stratified_lengths(spark, folder):
    rows = facts.guided(spark, folder).withColumn("length", I.capped_length(F.col("inferred_amplicon_length")))
    return rows.groupBy("category", "subcategory", "length").agg(F.count("*").alias("n"))


@query(", b as (select * from (values ('short', 0, 150), ('middle', 151, 200), ('long', 201, 1000)) as t(bucket, a, z)) select bucket, count(*) as n from gr left join b on inferred_amplicon_length between a and z group by bucket")
def length_ranges(spark, folder):
    buckets = spark.createDataFrame([("short", 0, 150), ("middle", 151, 200), ("long", 201, 1000)], "bucket string, low int, high int")
    return I.length_buckets(facts.guided(spark, folder), "inferred_amplicon_length", buckets).groupBy("bucket").agg(F.count("*").alias("n"))


@query(r", g as (select guide, subcategory, regexp_extract(details, '(?:^|;)G:(\d+),(\d+)', 2) as l from gr where category = 'genomic insertion' and perfect) select guide, subcategory, l::int as length, count(*) as n from g where l <> '' group by all")
def foreign_insertion_lengths(spark, folder):
    return _foreign(spark, folder)


def _foreign(spark, folder):
    rows = facts.guided(spark, folder).filter("category = 'genomic insertion' and perfect").withColumn("length", O.foreign_length(F.col("details"))).filter("length is not null")
    return rows.groupBy("guide", "subcategory", "length").agg(F.count("*").alias("n"))


@query(
    r""", g as (select guide, subcategory, regexp_extract(details, '(?:^|;)G:(\d+),(\d+)', 2) as l from gr where category = 'genomic insertion' and perfect), gl as (select guide, subcategory, case when l::int <= 75 then '<=75 nts' else '>75 nts' end as details, count(*) as n from g where l <> '' group by all)
select guide, category, subcategory, details, n from cnt where not (category = 'genomic insertion' and details = 'collapsed') union all select guide, 'genomic insertion', subcategory, details, n from gl
union all select c.guide, c.category, c.subcategory, c.details, c.n from cnt c where category = 'genomic insertion' and details = 'collapsed' and not exists (select 1 from gl where gl.guide = c.guide and gl.subcategory = c.subcategory)"""
)
def outcome_counts_split_lengths(spark, folder):
    return C.split_foreign_lengths(facts.counts(spark, folder), _foreign(spark, folder))


_INS = r""", i as (select category, subcategory, guide, regexp_extract(details, '(?:^|;)I:(\d+),([ACGTN]+)', 1) as s, regexp_extract(details, '(?:^|;)I:(\d+),([ACGTN]+)', 2) as b from gr where perfect)
"""


@query(_INS + "select category, subcategory, field, value, count(*) as n from (select category, subcategory, 'start' as field, s::int as value from i where s <> '' union all select category, subcategory, 'length', length(b)::int from i where s <> '') group by all")
def insertion_value_histogram(spark, folder):
    rows = facts.guided(spark, folder).filter("perfect").withColumn("start", O.insertion_start(F.col("details"))).withColumn("length", F.length(O.inserted_bases(F.col("details")))).filter("start is not null")
    long = rows.unpivot(["category", "subcategory"], ["start", "length"], "field", "value")
    return long.groupBy("category", "subcategory", "field", "value").agg(F.count("*").alias("n"))


@query(r", u as (select guide, regexp_extract(details, '(?:^|;)U:(\d+),(\d+)', 1) as s, regexp_extract(details, '(?:^|;)U:(\d+),(\d+)', 2) as l from gr where perfect) select s::int as start, s::int + l::int - 1 as stop, count(*) as n from u where s <> '' group by all")
def duplication_junctions(spark, folder):
    rows = facts.guided(spark, folder).filter("perfect").withColumn("start", O.duplication_start(F.col("details"))).withColumn("stop", F.col("start") + O.duplication_length(F.col("details")) - 1).filter("start is not null")
    return rows.groupBy("start", "stop").agg(F.count("*").alias("n"))


@query(r", m as (select regexp_extract(details, '(?:^|;)M:(\d+)', 1) as p from gr where perfect), v as (select p::int as value, count(*) as n from m where p <> '' group by all) select cast(g as int) as value, coalesce(v.n, 0) as n from unnest(range(0, 217)) as t(g) left join v on v.value = g")
def truncation_positions(spark, folder):
    rows = facts.guided(spark, folder).filter("perfect").withColumn("p", O.misintegration_place(F.col("details"))).withColumn("all", F.lit(1))
    return I.dense_histogram(rows, ["all"], "p", 0, 216).select("value", "n")


_SNV = r""", s as (select guide, regexp_extract(details, '(?:^|;)S:(\d+)([ACGTN])', 1) as p, regexp_extract(details, '(?:^|;)S:(\d+)([ACGTN])', 2) as b, n from cnt), sn as (select guide, p::int as place, b as base, n from s where p <> '')
"""


@query(_SNV + ", r as (select guide, place - 110 as o, base, sum(n) as n from sn group by all) select lib.guide, cast(o.o as int) as \"offset\", bs.base, round(coalesce(r.n, 0) / own.total, 6) as rate from lib cross join unnest(range(-100, 100)) as o(o) cross join (values ('T'), ('C'), ('A'), ('G')) as bs(base) left join r on r.guide = lib.guide and r.o = o.o and r.base = bs.base left join own on own.guide = lib.guide")
def mismatch_rates_densified(spark, folder):
    cnt = facts.counts(spark, folder)
    changes = cnt.withColumn("place", O.change_place(F.col("details"))).withColumn("base", O.change_base(F.col("details"))).filter("place is not null")
    out = I.mismatch_rates(changes, ["guide"], C.totals(cnt, ["guide"]), 110, -100, 99, facts.guides(spark, folder).select("guide"))
    return out.withColumn("rate", r6("rate"))


@query(_SNV + ", c as (select guide, sum(n) filter (place between 100 and 120) as n from sn group by guide), f as (select lib.guide, lib.is_nt, coalesce(c.n, 0) as n, own.total from lib left join c on c.guide = lib.guide left join own on own.guide = lib.guide), b as (select sum(n) / sum(total) as base from f where is_nt) select guide, round(n / total, 6) as fraction, round(log2(nullif(n / total / base, 0)), 6) as log2_fc from f, b")
def snv_conversion_fractions(spark, folder):
    """Share of records with a change in the window of the edit, and against the controls."""
    cnt = facts.counts(spark, folder)
    changed = cnt.withColumn("place", O.change_place(F.col("details"))).filter("place between 100 and 120").groupBy("guide").agg(F.sum("n").alias("n"))
    rows = facts.guides(spark, folder).select("guide", "is_nt").join(changed, "guide", "left").join(C.totals(cnt, ["guide"]), "guide", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    nt = rows.filter("is_nt").agg(F.sum("n"), F.sum("total")).first()
    base = float(nt[0]) / float(nt[1]) if nt[1] else None
    fraction = safe_ratio(F.col("n"), F.col("total"))
    return rows.select("guide", r6(fraction).alias("fraction"), r6(log2_or_null(safe_ratio(fraction, F.lit(base)))).alias("log2_fc"))


@query(
    r""", e as (select guide, n, regexp_extract(details, '(?:^|;)D:(\d+),(\d+)', 2) <> '' as d, regexp_extract(details, '(?:^|;)I:(\d+),([ACGTN]+)', 2) <> '' as i, regexp_extract(details, '(?:^|;)S:(\d+)([ACGTN])', 2) <> '' as s from cnt),
x as (select guide, unnest(list_filter([case when d then 'deletion' end, case when i then 'insertion' end, case when s then 'change' end], lambda v: v is not null)) as edit, n from e)
select x.guide, edit, cast(sum(n) as bigint) as n, round(sum(n) / any_value(own.total), 6) as fraction from x join own on own.guide = x.guide group by x.guide, edit"""
)
def programmed_edit_fractions(spark, folder):
    """An outcome counts in every kind of edit that it contains."""
    cnt = facts.counts(spark, folder)
    d = F.col("details")
    edits = F.array_compact(F.array(F.when(O.deletion_start(d).isNotNull(), "deletion"), F.when(O.insertion_start(d).isNotNull(), "insertion"), F.when(O.change_place(d).isNotNull(), "change")))
    rows = cnt.select("guide", F.explode(edits).alias("edit"), "n").groupBy("guide", "edit").agg(F.sum("n").alias("n"))
    return rows.join(C.totals(cnt, ["guide"]), "guide").select("guide", "edit", "n", r6(safe_ratio(F.col("n"), F.col("total"))).alias("fraction"))


@query(_DEL + f"select start - {CUT} as anchored, 2 * {CUT} + 1 - stop as flipped, 'D:' || (2 * {CUT} + 1 - stop) || ',' || length as details, cast(sum(n) as bigint) as n from iv group by all")
def coordinate_conversion(spark, folder):
    rows = _intervals(spark, folder).withColumn("flipped", O.flip(F.col("start"), F.col("length"), CUT))
    return rows.groupBy(O.shift(F.col("start"), CUT).alias("anchored"), "flipped", O.format_deletion(F.col("flipped"), F.col("length")).alias("details")).agg(F.sum("n").alias("n"))


@query(", c as (select guide, pool, count(*) as n from gr where perfect and category = 'genomic insertion' group by all), p as (select pool, guide, is_nt, count(*) as total from gr where perfect group by all) select p.pool, p.guide, round(coalesce(c.n, 0) / p.total, 6) as fraction from p left join c on c.pool = p.pool and c.guide = p.guide")
def foreign_fractions_by_pool(spark, folder):
    rows = facts.guided(spark, folder).filter("perfect").groupBy("pool", "guide").agg(F.count("*").alias("total"), F.sum((F.col("category") == "genomic insertion").cast("long")).alias("n"))
    return rows.select("pool", "guide", r6(F.col("n") / F.col("total")).alias("fraction"))


@query(_DEL + ", c as (select start, cast(sum(n) as bigint) as n from iv group by start) select start, n, cast(sum(n) over (order by start) as bigint) as up_to, cast(sum(n) over (order by start desc) as bigint) as from_here from c")
def cumulative_starts(spark, folder):
    rows = _intervals(spark, folder).groupBy("start").agg(F.sum("n").alias("n"))
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("start"), F.desc("start")))
    return rows.select("start", "n", F.sum("n").over(up).alias("up_to"), F.sum("n").over(down).alias("from_here"))
