"""The fact and dimension tables that the query plans share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.folding import fold_dna, fold_name
from tessera.operators.counts import DETAILS_COLLAPSED, OUTCOME, SUBCATEGORY_COLLAPSED, most_frequent, outcome_counts, pooled_controls
from tessera.operators.library import guide_dimension
from tessera.session import materialize
from tessera.sources.tables import table

#: Number of outcomes over which the activity of guides is measured.
FREQUENT_OUTCOMES = 100
#: Number of outcomes that count as most frequent, as in the reference.
MOST_FREQUENT_OUTCOMES = 1000


def preferred_promoters(library: DataFrame) -> DataFrame:
    return library.filter("promoter is not null").groupBy("gene").agg(F.min("promoter").alias("best_promoter"))


def guides(spark: SparkSession, folder: str) -> DataFrame:
    library = table(spark, folder, "guide_library")
    return guide_dimension(library, preferred_promoters(library))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record once, in its latest delivery; names and sequences folded."""
    rows = table(spark, folder, "collapsed_umis")
    latest = rows.withColumn("_r", F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("ingested_at")))).filter("_r = 1")
    return latest.select(
        "record_id", F.col("screen_name").alias("screen"), F.regexp_extract("screen_name", "site-([A-Z])", 1).alias("pool"), "umi", fold_name("guide").alias("guide"), "guide_mismatch", (F.col("guide_mismatch") == -1).alias("perfect"),
        "cluster_id", "num_reads", "inferred_amplicon_length", *OUTCOME, "common_sequence_name", fold_dna("seq").alias("seq"),
    )


def guided(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a guide of the library, with its gene and whether it is a control."""
    return records(spark, folder).join(guides(spark, folder).select("guide", "gene", "is_nt"), "guide")


def counts(spark: SparkSession, folder: str, by: list[str] | None = None) -> DataFrame:
    """Collapsed outcome counts of perfect guides, written once: all statistics start from this small table."""
    rows = outcome_counts(guided(spark, folder).filter("perfect"), [*(by or []), "guide", "is_nt"])
    return materialize(rows, "outcome-counts")


def frequent(count_table: DataFrame, k: int = MOST_FREQUENT_OUTCOMES) -> DataFrame:
    return most_frequent(pooled_controls(count_table), "nt_n", k)


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """Every read once, in its latest delivery."""
    rows = table(spark, folder, "umi_reads")
    latest = rows.withColumn("_r", F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("ingested_at"), F.desc("attempt"), "chunk_number"))).filter("_r = 1").drop("_r")
    return latest.withColumns({"quartet_name": fold_name("quartet_name"), "umi": fold_dna("umi"), "guide": fold_dna("guide"), "seq": fold_dna("seq")})


def _list(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


SQL = f"""
with pref as (select gene, min(promoter) as best_promoter from guide_library where promoter is not null group by gene),
lib as (
  select upper(trim(l.short_name)) as guide, l.gene, coalesce(l.promoter, 'P1P2') as promoter, l.guide_rank as rank, l.protospacer, l.full_seq, l.guide_barcode, l.gamma,
    l.gene = 'non-targeting' as is_nt, coalesce(coalesce(l.promoter, 'P1P2') = p.best_promoter, true) as is_best_promoter
  from guide_library l left join pref p on l.gene = p.gene),
rec as (
  select record_id, screen_name as screen, regexp_extract(screen_name, 'site-([A-Z])', 1) as pool, umi, upper(trim(guide)) as guide, guide_mismatch, guide_mismatch = -1 as perfect, cluster_id, num_reads,
    inferred_amplicon_length, category, subcategory, details, common_sequence_name, upper(seq) as seq
  from collapsed_umis qualify row_number() over (partition by record_id order by ingested_at desc) = 1),
gr as (select r.*, l.gene, l.is_nt from rec r join lib l on r.guide = l.guide),
kr as (
  select * replace (case when category in ({_list(SUBCATEGORY_COLLAPSED)}) then 'collapsed' else subcategory end as subcategory,
    case when category in ({_list(DETAILS_COLLAPSED)}) then 'collapsed' else details end as details) from gr),
cnt as (select guide, is_nt, category, subcategory, details, count(*) as n from kr where perfect group by all),
own as (select guide, sum(n) as total from cnt group by guide),
nt as (select category, subcategory, details, sum(n) as nt_n from cnt where is_nt group by all),
ntf as (select *, nt_n / (select sum(nt_n) from nt) as nt_fraction from nt),
top as (select category, subcategory, details, nt_n from nt order by nt_n desc, category, subcategory, details limit {MOST_FREQUENT_OUTCOMES}),
dense as (
  select lib.guide, lib.gene, lib.is_nt, lib.is_best_promoter, top.category, top.subcategory, top.details, coalesce(cnt.n, 0) as n, own.total, coalesce(cnt.n, 0) / nullif(own.total, 0) as fraction, coalesce(ntf.nt_fraction, 0) as nt_fraction
  from lib cross join top left join cnt on cnt.guide = lib.guide and cnt.category = top.category and cnt.subcategory = top.subcategory and cnt.details = top.details
  left join own on own.guide = lib.guide left join ntf on ntf.category = top.category and ntf.subcategory = top.subcategory and ntf.details = top.details),
fc as (
  select *, case when fraction is null then null when fraction = 0 and nt_fraction = 0 then 5.0 when fraction = 0 then -5.0 when nt_fraction = 0 then 'inf'::double else log2(fraction / nt_fraction) end as log2_fc from dense),
rd as (
  select * replace (upper(trim(quartet_name)) as quartet_name, upper(umi) as umi, upper(guide) as guide, upper(seq) as seq) from umi_reads
  qualify row_number() over (partition by read_id order by ingested_at desc, attempt desc, chunk_number) = 1)
"""
