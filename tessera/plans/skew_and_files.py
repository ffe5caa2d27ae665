"""Queries of the general problems: heavy keys (p4) and small files (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.folding import fold_name
from tessera.operators.compaction import file_report, pack_files, pack_stored_files, stored_segments
from tessera.operators.skew import heavy_keys, totals_per_key
from tessera.sources.tables import table

HEAVY_SHARE = 0.05
BLOCK_BYTES = 64 << 20


def _named_totals(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "collapsed_umis")
    totals = heavy_keys(totals_per_key(records, fold_name("guide"), F.col("record_id"), F.col("num_reads")), HEAVY_SHARE)
    library = table(spark, folder, "guide_library").groupBy(fold_name("short_name").alias("key")).agg(F.min("short_name").alias("guide"))
    return totals.join(library, "key", "left")


def p4_guide_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _named_totals(spark, folder).select(F.coalesce("guide", "key").alias("guide"), "n_records", F.col("total").cast("long").alias("num_reads"), "is_heavy")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _named_totals(spark, folder).filter("is_heavy and guide is not null").select("guide")


def _report(spark: SparkSession, folder: str) -> DataFrame:
    reads = table(spark, folder, "umi_reads")
    archive = pack_files(reads, "quartet_name", "chunk_number", "read_id", ["ingested_at"], BLOCK_BYTES)
    return file_report(archive, table(spark, folder, "chunk_files"), "quartet_name", "chunk_number", "num_reads")


def p5_file_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder).select(F.col("grp").alias("quartet_name"), F.col("num").alias("chunk_number"), "n_rows", "n_declared", "is_repeated", "is_miscounted", "is_missing")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder).filter("not as_is").select(F.col("grp").alias("quartet_name"), F.col("num").alias("chunk_number"))


def p5_stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of the folder, packed as they are and read back: bytes and checksum of each one."""
    parts = stored_segments(pack_stored_files(spark, folder, BLOCK_BYTES))
    name = F.element_at(F.split("path", "/"), -1)
    return parts.groupBy(name.alias("file_name")).agg(F.sum(F.length("content")).alias("n_bytes"), F.count("*").alias("n_segments"), F.min(F.crc32("content")).alias("least_crc32"))


QUERIES = {"p5_stored_files": p5_stored_files, "p4_found": p4_found, "p4_guide_totals": p4_guide_totals, "p5_found": p5_found, "p5_file_report": p5_file_report}

_RECORDS = """
with recs as (
  select record_id, max(upper(trim(guide))) as g, max(coalesce(num_reads, 0)) as nr
  from collapsed_umis group by record_id),
tot as (select g, count(*) as n_records, sum(nr) as num_reads from recs group by g),
lib as (select upper(trim(short_name)) as g, min(short_name) as guide from guide_library group by 1),
flagged as (
  select t.g, lib.guide, t.n_records, t.num_reads,
    t.g is not null and (t.n_records * 20 >= (select sum(n_records) from tot) or t.num_reads * 20 >= (select sum(num_reads) from tot)) as is_heavy
  from tot t left join lib on t.g = lib.g)
"""

_FILES = """
with r as (select read_id, upper(trim(quartet_name)) as q, chunk_number as c from umi_reads),
rep as (select read_id from r group by read_id having count(*) > 1),
seen as (
  select q, c, count(*) as n_rows, count(distinct r.read_id) as n_ids,
    bool_or(rep.read_id is not null) as is_repeated
  from r left join rep on r.read_id = rep.read_id group by q, c),
listed as (select upper(trim(quartet_name)) as q, chunk_number as c, max(num_reads) as n_declared from chunk_files group by 1, 2),
j as (
  select coalesce(s.q, l.q) as quartet_name, coalesce(s.c, l.c) as chunk_number, s.n_rows, s.n_ids, l.n_declared,
    coalesce(s.is_repeated, false) as is_repeated, s.q is null or l.q is null as is_missing
  from seen s full outer join listed l on s.q = l.q and s.c = l.c)
"""

ORACLE = {
    "p4_guide_totals": _RECORDS + "select coalesce(guide, g) as guide, n_records, cast(num_reads as bigint) as num_reads, is_heavy from flagged",
    "p4_found": _RECORDS + "select guide from flagged where is_heavy and guide is not null",
    "p5_file_report": _FILES + "select quartet_name, chunk_number, n_rows, cast(n_declared as bigint) as n_declared, is_repeated, (not is_missing) and n_ids is distinct from n_declared as is_miscounted, is_missing from j",
    "p5_found": _FILES + "select quartet_name, chunk_number from j where is_repeated or is_missing or n_ids is distinct from n_declared",
}
