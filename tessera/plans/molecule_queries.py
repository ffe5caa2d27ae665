"""Queries on reads: demultiplexing, molecules, quality, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dna
from tessera.operators import categorise as K
from tessera.operators import demux as D
from tessera.operators import library as L
from tessera.operators import umi as U
from tessera.operators.alignments import align_reads
from tessera.operators.counts import OUTCOME
from tessera.plans import facts
from tessera.plans.facts import SQL
from tessera.session import materialize
from tessera.sources.tables import table

GUIDE_LENGTH = 45
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = prefix + sql
        return f

    return add


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    return facts.guides(spark, folder).select("guide", F.substring(F.upper("full_seq"), 1, GUIDE_LENGTH).alias("expected"))


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    names = D.resolver(_expected(spark, folder), "guide", "expected")
    return D.assign(facts.reads(spark, folder), F.substring("guide", 1, GUIDE_LENGTH), names, "guide_name")


_DEMUX = """, exp as (select guide as name, substr(upper(full_seq), 1, 45) as expected from lib),
ds as (select distinct guide as s from rd),
near as (
  select s, name from ds join exp on length(s) = length(expected) and substr(s, 1, 22) = substr(expected, 1, 22) and hamming(s, expected) <= 1
  union select s, name from ds join exp on length(s) = length(expected) and substr(s, 23) = substr(expected, 23) and hamming(s, expected) <= 1),
res as (select s, case when count(distinct name) = 1 then min(name) else 'unknown' end as guide_name from near group by s),
asg as (select rd.*, coalesce(res.guide_name, 'unknown') as guide_name from rd left join res on rd.guide = res.s)
"""


@query(_DEMUX + "select read_id, guide_name from asg")
def barcode_demux(spark, folder):
    return _assigned(spark, folder).select("read_id", "guide_name")


@query(_DEMUX + "select quartet_name, guide_name, count(*) as n from asg group by all")
def demux_counts(spark, folder):
    return D.key_counts(_assigned(spark, folder), ["quartet_name", "guide_name"])


@query(_DEMUX + ", c as (select guide_name, count(*) as n from asg group by all) select guide_name, n, row_number() over (order by n desc, guide_name) as place from c where guide_name <> 'unknown'")
def work_order(spark, folder):
    return D.work_order(D.key_counts(_assigned(spark, folder), ["guide_name"]), "guide_name").withColumn("place", F.col("place").cast("long"))


@query(_DEMUX + """, cs as (select guide as seq, count(*) as n from rd group by guide), kinds as (select s, count(distinct name) as names from near group by s)
select seq, n, round(n / (select sum(n) from cs), 6) as fraction, case when seq in (select expected from exp) then 'exact' when k.names = 1 then 'mismatch' when k.names > 1 then 'ambiguous' else 'unknown' end as kind
from cs left join kinds k on k.s = cs.seq order by n desc, seq limit 100""")
def demux_stats_top100(spark, folder):
    expected = _expected(spark, folder)
    names = D.resolver(expected, "guide", "expected")
    out = D.top_sequences(facts.reads(spark, folder), F.col("guide"), names, expected.select(F.col("expected").alias("seq")))
    return out.select("seq", "n", F.round("fraction", 6).alias("fraction"), "kind")


_SAMPLES = [("sample_a", "AC", "GT"), ("sample_b", "CA", "GT"), ("sample_c", "GG", "TT"), ("sample_d", "TT", "AA")]
_DUAL = """, smp as (select * from (values ('sample_a', 'AC', 'GT'), ('sample_b', 'CA', 'GT'), ('sample_c', 'GG', 'TT'), ('sample_d', 'TT', 'AA')) as t(name, i7, i5)),
ix as (select read_id, substr(umi, 1, 2) as a, substr(umi, 11, 2) as b from rd where umi is not null),
hit as (select ix.read_id, name from ix join smp on hamming(a, i7) <= 1 and hamming(b, i5) <= 1 where length(a) = 2 and length(b) = 2)
select ix.read_id, coalesce(h.name, 'unknown') as sample, coalesce(h.name, a || '+' || b) as sample_key from ix left join (select read_id, min(name) as name from hit group by read_id having count(*) = 1) h on h.read_id = ix.read_id"""


@query(_DUAL)
def dual_index_demux(spark, folder):
    """Samples by two index sequences; here the ends of the barcode play the indices."""
    samples = spark.createDataFrame(_SAMPLES, "name string, i7 string, i5 string")
    rows = facts.reads(spark, folder).filter("umi is not null").select("read_id", F.substring("umi", 1, 2).alias("a"), F.substring("umi", 11, 2).alias("b"))
    return D.assign_by_two(rows, F.col("a"), F.col("b"), D.resolver(samples, "name", "i7"), D.resolver(samples, "name", "i5"), "sample").select("read_id", "sample", "sample_key")


@query(", c as (select substr(case when strpos(substr(guide, 1, 10 + 3), 'GTAT') > 0 then substr(guide, strpos(substr(guide, 1, 13), 'GTAT')) else guide end, 1, 20) as s, count(*) as n from rd group by all) select lib.guide, coalesce(c.n, 0) as n from lib left join c on c.s = substr(lib.full_seq, 1, 20)")
def library_composition(spark, folder):
    return D.library_composition(facts.reads(spark, folder), F.col("guide"), "GTAT", facts.guides(spark, folder), "full_seq", 20)


@query()
def variant_table_size(spark, folder):
    """Entries of the expanded dictionary, which has to stay small next to the reads."""
    return D.resolver(_expected(spark, folder), "guide", "expected").agg(F.count("*").alias("entries"), F.sum((F.size("names") > 1).cast("long")).alias("ambiguous"))


_MIS = _DEMUX + """, m as (
  select read_id, asg.guide as s, e.expected as e, guide_qual as q from asg join exp e on e.name = asg.guide_name where guide_qual is not null),
p as (select read_id, s = e as same, list_filter(range(0, 45), lambda i: substr(s, i + 1, 1) <> substr(e, i + 1, 1)) as all_at, list_filter(range(0, 45), lambda i: substr(s, i + 1, 1) <> substr(e, i + 1, 1) and ascii(substr(q, i + 1, 1)) - 33 >= 30) as pl from m)
"""


def _mismatched(spark, folder):
    rows = _assigned(spark, folder).filter("guide_name <> 'unknown' and guide_qual is not null")
    return rows.join(_expected(spark, folder).withColumnRenamed("guide", "guide_name"), "guide_name")


@query(_MIS + "select read_id, cast(case when same or len(pl) = 0 then -1 when len(pl) = 1 then pl[1] end as int) as mismatch, array_to_string(all_at, ':') as positions from p")
def guide_mismatch_classify(spark, folder):
    rows = _mismatched(spark, folder)
    return rows.select("read_id", dna.classify_guide(F.col("guide"), F.col("expected"), F.col("guide_qual")).alias("mismatch"), F.array_join(dna.mismatch_positions(F.col("guide"), F.col("expected")).cast("array<string>"), ":").alias("positions"))


@query(_MIS + ", c as (select cast(pl[1] as int) as place from p where not same and len(pl) = 1) select place, count(*) as n, round(count(*) / (select count(*) from p), 6) as rate from c group by place")
def guide_mismatch_rates(spark, folder):
    rows = _mismatched(spark, folder).select(dna.classify_guide(F.col("guide"), F.col("expected"), F.col("guide_qual")).alias("place"))
    whole = rows.count() or 1
    return rows.filter("place >= 0").groupBy("place").agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(whole), 6).alias("rate"))


@query("select read_id, round(sure, 6) as sure, coalesce(sure > 0.6, false) as passes from (select read_id, len(list_filter(range(1, length(qual) + 1), lambda i: ascii(substr(qual, i, 1)) - 33 >= 30)) / nullif(length(qual), 0) as sure from rd)")
def quality_split(spark, folder):
    rows = facts.reads(spark, folder).select("read_id", F.round(dna.quality_fraction(F.col("qual")), 6).alias("sure"))
    return D.quality_split(rows, F.col("sure"))


@query("select read_id, length(seq) - length(replace(seq, 'N', '')) as uncalled, coalesce(list_max(list_transform(regexp_extract_all(seq, 'G+'), lambda x: length(x))), 0) as longest_g, reverse(translate(seq, 'ACGT', 'TGCA')) as reverse_complement from rd where seq is not null")
def sequence_features(spark, folder):
    rows = facts.reads(spark, folder).filter("seq is not null")
    return rows.select("read_id", dna.count_letter(F.col("seq"), "N").alias("uncalled"), dna.longest_run(F.col("seq"), "G").alias("longest_g"), dna.reverse_complement(F.col("seq")).alias("reverse_complement"))


@query("select seq, count(*) as n, row_number() over (order by count(*) desc, seq) - 1 as rank from rd where seq is not null group by seq having count(*) > 1")
def common_sequences(spark, folder):
    return U.common_sequences(facts.reads(spark, folder), "seq").withColumn("rank", F.col("rank").cast("long"))


@query("select record_id from rec where seq is not null and seq not in (select upper(seq) from common_sequence_outcomes where seq is not null)")
def uncommon_sequences(spark, folder):
    known = table(spark, folder, "common_sequence_outcomes").select(F.upper("seq").alias("seq")).distinct()
    return facts.records(spark, folder).filter("seq is not null").join(known, "seq", "left_anti").select("record_id")


@query("select r.record_id, c.common_sequence_name, c.category, c.subcategory, c.details from rec r join common_sequence_outcomes c on r.seq = upper(c.seq)")
def known_outcomes(spark, folder):
    """Sequences that were categorised before take their outcome from the table."""
    known = table(spark, folder, "common_sequence_outcomes").select("common_sequence_name", F.upper("seq").alias("seq"), *OUTCOME)
    return facts.records(spark, folder).select("record_id", "seq").join(known, "seq").select("record_id", "common_sequence_name", *OUTCOME)


_VOTES = """, v as (select guide, umi, category, subcategory, details, sum(num_reads) as reads, arg_min(record_id, (-num_reads, record_id)) as representative from gr where num_reads is not null
  and not (category = 'bad sequence' or (category = 'no indel' and subcategory = 'other' and details = 'ambiguous')) group by all)
"""


def _votes(spark, folder):
    rows = U.relevant(facts.guided(spark, folder)).filter("num_reads is not null")
    return U.votes(rows, ["guide", "umi"], "num_reads", "record_id")


@query(_VOTES + "select guide, umi, category, subcategory, details, cast(reads as bigint) as reads, representative from v")
def umi_collapse_all(spark, folder):
    return _votes(spark, folder)


@query(_VOTES + ", w as (select *, rank() over (partition by guide, umi order by reads desc) as r from v), f as (select *, count(*) over (partition by guide, umi) as ties from w where r = 1) select guide, umi, category, subcategory, details, cast(reads as bigint) as reads, representative from f where ties = 1 and reads >= 4")
def umi_collapse_winner(spark, folder):
    return U.winners(_votes(spark, folder), ["guide", "umi"]).filter("reads >= 4")


@query("select guide, umi, record_id, row_number() over (partition by guide, umi order by num_reads desc, record_id) - 1 as cluster_number from gr where num_reads >= 2")
def cluster_numbering(spark, folder):
    rows = facts.guided(spark, folder).filter("num_reads >= 2")
    return U.number_clusters(rows, ["guide", "umi"], "num_reads", ["record_id"]).select("guide", "umi", "record_id", F.col("cluster_number").cast("long").alias("cluster_number"))


@query("select guide, umi, list_reverse_sort(list(num_reads)) as sizes from gr where num_reads is not null group by guide, umi")
def cluster_sizes(spark, folder):
    return U.cluster_sizes(facts.guided(spark, folder).filter("num_reads is not null"), ["guide", "umi"], "num_reads")


@query("select num_reads, category, subcategory, details, count(*) as n from gr where num_reads is not null group by grouping sets ((num_reads), (num_reads, category, subcategory), (num_reads, category, subcategory, details))")
def reads_per_umi_grouping_sets(spark, folder):
    return U.reads_per_umi(facts.guided(spark, folder).filter("num_reads is not null"), "num_reads").drop("level")


@query(
    """, c as (select guide, umi as barcode, sum(num_reads) as reads from gr where umi is not null and num_reads is not null group by all),
nb as (
  select a.guide, a.barcode, arg_min(b.barcode, (-b.reads, b.barcode)) as up from c a join c b on a.guide = b.guide and length(a.barcode) = length(b.barcode) and hamming(a.barcode, b.barcode) <= 1 group by all),
ch as (with recursive w as (select guide, barcode, up, 0 as d from nb union all select w.guide, w.barcode, nb.up, d + 1 from w join nb on nb.guide = w.guide and nb.barcode = w.up and nb.up <> w.up where d < 100) select guide, barcode, arg_max(up, d) as corrected from w group by all)
select guide, barcode, corrected from ch"""
)
def umi_correction(spark, folder):
    rows = facts.guided(spark, folder).filter("num_reads is not null")
    return U.correct_barcodes(rows, ["guide"], "umi", "num_reads")


@query()
def consensus_reads(spark, folder):
    """Consensus clusters of the reads of every barcode in its quartet."""
    return U.collapse_reads(facts.reads(spark, folder), ["quartet_name", "umi"], "read_id", "seq", "qual")


# -- categories from alignments ---------------------------------------------

_CUT = 47


@query(
    f""", t as (select seq as tg, length(seq) as tl from rec where seq is not null group by seq order by count(*) desc, seq limit 1),
s as (select distinct seq, length(seq) as n, tg, tl, substr(tg, 1, {_CUT + 1}) as head, substr(tg, {_CUT + 2}) as tail from rec, t where seq is not null),
h as (select *, case when n = tl then list_sum(list_transform(range(1, n + 1), lambda i: (substr(seq, i, 1) <> substr(tg, i, 1))::int)) end as edits,
  list_max(list_filter(range(4, least(20, n) + 1), lambda k: contains(head, substr(seq, 1, k)))) as lk, list_max(list_filter(range(4, least(20, n) + 1), lambda k: contains(tail, right(seq, k)))) as rk from s),
p as (select *, strpos(head, substr(seq, 1, lk)) - 1 as la, {_CUT + 1} + length(tail) - (strpos(reverse(tail), reverse(right(seq, rk))) - 1) - rk as ra from h),
e as (select *, coalesce(list_min(list_filter(range(lk, n), lambda i: la + i >= tl or substr(seq, i + 1, 1) <> substr(tg, la + i + 1, 1))), n) as lm,
  coalesce(list_min(list_filter(range(rk, n), lambda i: ra - (i - rk) <= 0 or substr(seq, n - i, 1) <> substr(tg, ra - (i - rk), 1))), n) as rm from p),
g as (select *, case when lk is not null and rk is not null then greatest(0, lm + rm - n) end as shared from e),
f as (select *, la + lm - 1 as l_end, ra - (rm - rk) + shared as r_at, n - rm + shared as q_at from g),
i as (select *, edits is not null and edits <= 0.1 * n as same, lk is not null and rk is not null and r_at > l_end as joined, r_at - l_end - 1 as removed, q_at - lm as inserted, l_end + 1 as pl from f),
c as (select seq, n, case when same then 'same' when joined and removed = 0 and inserted = 0 then 'none' when joined and removed > 0 and inserted > 0 then 'both' when joined and removed > 0 then 'D' when joined then 'I' when lk is not null and (lm >= n - 2) or rk is not null and rm >= n - 2 then 'end' when lk is null and rk is null then 'unmapped' else 'apart' end as kind,
  edits, la, removed, inserted, pl, case when not same and joined and removed > 0 then pl + removed - 1 else pl end as stop, case when lk is not null and lm >= n - 2 then la else ra - (rm - rk) end as end_at,
  lk, rk from i),
d as (select *, pl <= {_CUT + 5} and stop >= {_CUT - 5} as near, pl <= {_CUT + 5} and pl >= {_CUT - 5} as near_i from c)
select rec.record_id,
  case when kind = 'unmapped' then 'bad sequence' when n <= 50 then 'nonspecific amplification' when kind = 'same' and edits = 0 or kind = 'none' and la <= 2 then 'wild type' when kind = 'none' then 'truncation' when kind = 'same' then 'mismatches' when kind in ('D', 'I') and not near and greatest(removed, inserted) <= 3 then 'wild type'
    when kind in ('D', 'I') and not near then 'uncategorized' when kind = 'D' then 'deletion' when kind = 'I' then 'insertion' when kind = 'both' and (near or near_i) then 'deletion + insertion' when kind = 'both' then 'multiple indels' when kind = 'end' and end_at <= 2 then 'wild type' when kind = 'end' then 'truncation' when lk is not null and rk is not null then 'duplication' when n - length(replace(d.seq, 'N', '')) > 10 or contains(d.seq, repeat('G', 20)) then 'bad sequence' else 'uncategorized' end as category,
  case when kind in ('unmapped') or n <= 50 then 'n/a' when kind = 'D' and near then 'D:' || pl || ',' || removed when kind = 'I' and near then 'I:' || pl || ',' || inserted when kind = 'both' and (near or near_i) then 'D:' || pl || ',' || removed || ';I:' || pl || ',' || inserted when kind = 'apart' and lk is not null and rk is not null then 'simple' else 'n/a' end as details
from rec join d on d.seq = rec.seq"""
)
def categorise_sequences(spark, folder):
    """Categories from the sequences alone: aligned to the most frequent one, which stands for the target."""
    rows = materialize(facts.records(spark, folder).filter("seq is not null").select("record_id", "seq"), "sequences")
    top = rows.groupBy("seq").count().orderBy(F.desc("count"), "seq").first()
    size = len(top.seq) if top else 0
    target = K.Target(read_start=0, read_end=size - 1, cut=_CUT, primers=())
    # consensus sequences carry no scores
    aligned = align_reads(rows, top.seq if top else "", _CUT).withColumn("qual", F.rpad(F.lit("F"), F.length("seq"), "F"))
    return K.CATEGORISERS["pooled"](aligned, target).select("record_id", "category", "details")


@query("select category, subcategory, details, count(*) as n from gr where regexp_matches(details, '(^|;)S:\\d+A') and len(regexp_extract_all(details, '(?:^|;)S:\\d+A')) >= 1 group by all")
def details_with_change_to_a(spark, folder):
    return facts.guided(spark, folder).filter(K.details_at_least(1, "A")(F.col("details"))).groupBy(*OUTCOME).agg(F.count("*").alias("n"))


# -- the library --------------------------------------------------------------


@query("select guide, gene, promoter, rank, is_nt, is_best_promoter from lib")
def guide_library_flags(spark, folder):
    return facts.guides(spark, folder).select("guide", "gene", "promoter", "rank", "is_nt", "is_best_promoter")


@query("select guide, gene, rank from lib where gene in ('BRUBA1', 'BRUBA2', 'non-targeting') and is_best_promoter")
def gene_guides(spark, folder):
    return L.gene_guides(facts.guides(spark, folder), ["BRUBA1", "BRUBA2", L.NON_TARGETING], only_best=True).select("guide", "gene", "rank")


@query("select 'non_targeting_set_' || ((row_number() over (order by guide) - 1) // 4) as set_name, guide from lib where is_nt")
def control_sets(spark, folder):
    return L.control_sets(facts.guides(spark, folder))


@query(", s as (select 'non_targeting_set_' || ((row_number() over (order by guide) - 1) // 4) as set_name, guide from lib where is_nt) select coalesce(s.set_name, lib.gene) as gene, count(*) as n from lib left join s on s.guide = lib.guide group by 1")
def genes_with_control_sets(spark, folder):
    guides = facts.guides(spark, folder)
    return L.with_set_names(guides, L.control_sets(guides)).groupBy("gene").agg(F.count("*").alias("n"))


@query("select f.guide as fixed_guide, v.guide as variable_guide from lib f cross join lib v where f.is_nt and v.is_nt")
def control_pairs(spark, folder):
    nt = facts.guides(spark, folder).filter("is_nt")
    return L.combinations(nt, nt).select("fixed_guide", "variable_guide")


@query("select f.guide as fixed_guide, v.guide as variable_guide from lib f cross join lib v where (f.gene = 'BRUBA1' and (v.gene = 'BRUBA1' or v.is_nt)) or (f.is_nt and v.gene = 'BRUBA1')")
def guide_combinations_for_gene(spark, folder):
    guides = facts.guides(spark, folder)
    return L.combinations_for_gene(L.combinations(guides, guides), "BRUBA1")


@query("select f.guide as fixed_guide, v.guide as variable_guide from lib f cross join lib v where (f.gene = 'BRUBA1' and v.gene = 'BRUBA2') or (f.gene = 'BRUBA2' and v.gene = 'BRUBA1')")
def guide_combinations_for_pair(spark, folder):
    guides = facts.guides(spark, folder)
    return L.combinations_for_gene_pair(L.combinations(guides, guides), "BRUBA1", "BRUBA2")


@query("select letter, min(i) as first, max(i) as last, round(avg(i), 6) as middle from (select substr(guide, 1, 1) as letter, row_number() over (order by guide) - 1 as i from lib) group by letter")
def alphabetical_groups(spark, folder):
    return L.name_groups(facts.guides(spark, folder)).select("letter", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.round("middle", 6).alias("middle"))


@query("select guide, case when gene like 'BRU%' then 'new_' || gene else gene end as gene from lib")
def renamed_genes(spark, folder):
    guides = facts.guides(spark, folder)
    renamed = guides.filter(F.col("gene").startswith("BRU")).select(F.col("gene").alias("old_name"), F.concat(F.lit("new_"), "gene").alias("new_name")).distinct()
    return L.rename_genes(guides, renamed).select("guide", "gene")


@query(", f as (select record_id, guide, row_number() over (partition by gene order by record_id) as k from (select min(record_id) as record_id, guide, gene from gr group by guide, gene)) select lib.guide as gene_id, case when k = 1 then lib.gene else lib.gene || '_' || k end as name from f join lib on lib.guide = f.guide")
def unique_display_names(spark, folder):
    """Names of ids in the order in which they were first seen."""
    seen = facts.guided(spark, folder).select(F.col("guide").alias("gene_id"), F.col("gene").alias("name"), F.col("record_id").alias("seen"))
    return L.unique_display_names(seen)


@query("select l.guide, coalesce(count(g.record_id), 0) as n from lib l left join gr g on g.guide = l.guide and g.perfect group by l.guide")
def reindexed_guide_counts(spark, folder):
    counted = facts.guided(spark, folder).filter("perfect").groupBy("guide").agg(F.count("*").alias("n"))
    return L.reindex(facts.guides(spark, folder).select("guide"), counted, ["guide"], {"n": 0})


@query("select a.guide, a.is_nt from lib a where contains(lower(a.guide), 'nontarg') or contains(lower(a.guide), 'non-targeting')")
def controls_by_name(spark, folder):
    return facts.guides(spark, folder).filter(L.is_control(F.col("guide"))).select("guide", "is_nt")


@query("select screen, count(*) as n, count(distinct guide) as guides from gr group by screen")
def screens(spark, folder):
    return facts.guided(spark, folder).groupBy("screen").agg(F.count("*").alias("n"), F.countDistinct("guide").alias("guides"))
