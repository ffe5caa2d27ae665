"""Queries that write a source or sink and read it again, and streams over files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import demux as D
from tessera.plans import facts
from tessera.plans.facts import SQL
from tessera.session import scratch_root
from tessera.sources import bam, formats, screens, snapshots
from tessera.sources.tables import table
from tessera.streaming import demultiplex as ST

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = prefix + sql
        return f

    return add


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


@query("select cast(read_id as varchar) as name, seq, qual from rd where seq is not null and qual is not null")
def fastq_round_trip(spark, folder):
    path = _folder(spark, "fastq")
    rows = facts.reads(spark, folder).filter("seq is not null and qual is not null").select(F.col("read_id").cast("string").alias("name"), "seq", "qual")
    formats.to_fastq(rows).write.text(path)
    return formats.read_fastq(spark, path.removeprefix("file://") + "/part-*")


_BAM = """, u as (select read_id, quartet_name, seq, qual, read_id % 3 as k from rd where seq is not null and qual is not null and length(seq) = length(qual))
"""


def _bam_rows(spark, folder):
    """Reads with one to three alignments each, at places that follow from their length and number."""
    rows = facts.reads(spark, folder).filter("seq is not null and qual is not null and length(seq) = length(qual)")
    rows = rows.select("read_id", "quartet_name", F.col("read_id").cast("string").alias("name"), "seq", "qual", F.explode(F.sequence(F.lit(0), F.pmod("read_id", F.lit(3)).cast("int"))).alias("i"))
    first = F.col("i") == 0
    return rows.select("quartet_name", "name", F.when(first, 0).otherwise(256).alias("flag"), F.when(first, "target").otherwise("donor").alias("ref"), (F.col("i") * 7).cast("int").alias("pos"), F.lit(60).alias("mapq"), F.concat(F.length("seq") - 3, F.lit("M2D3S")).alias("cigar"), "seq", "qual")


@query(_BAM + "select read_id, quartet_name, seq, qual, k + 1 as n_alignments, k * 7 as last_pos, length(seq) - 1 as covered from u")
def bam_by_name(spark, folder):
    """Alignments written to one folder a quartet, read again and grouped by read name."""
    path = _folder(spark, "bam")
    bam.write_bam(_bam_rows(spark, folder), path, ["quartet_name"], ["name", "pos"], [("target", 216), ("donor", 120)])
    reads = bam.by_name(bam.read_bam(spark, path))
    quartets = facts.reads(spark, folder).select("read_id", "quartet_name")
    last = F.element_at("alignments", -1)
    out = reads.select(F.col("name").cast("long").alias("read_id"), "seq", "qual", F.size("alignments").cast("long").alias("n_alignments"), F.array_max("alignments.pos").cast("long").alias("last_pos"), bam.reference_length(last["cigar"]).cast("long").alias("covered"))
    return out.join(quartets, "read_id")


@query(_BAM + "select quartet_name, count(*) as n_records, count(distinct read_id) as n_reads from u, unnest(range(0, k + 1)) as t(i) group by quartet_name")
def bam_merged(spark, folder):
    """The files of all quartets in one, each name with the quartet it comes from."""
    path, whole = _folder(spark, "bam-parts"), _folder(spark, "bam-whole")
    rows = _bam_rows(spark, folder)
    files = bam.write_bam(rows, path, ["quartet_name"], ["name", "pos"])
    label = F.regexp_extract("path", "quartet_name=([^/]*)", 1)
    quartets = sorted((r.label, r.at) for r in files.groupBy(label.alias("label")).agg(F.min(F.regexp_extract("path", "(.*)/", 1)).alias("at")).collect())
    bam.write_bam(bam.merged([(q, bam.read_bam(spark, at)) for q, at in quartets], "|"), whole, [], ["name", "pos"])
    parts = F.split("name", "[|]")
    return bam.read_bam(spark, whole).groupBy(F.url_decode(parts[1]).alias("quartet_name")).agg(F.count("*").alias("n_records"), F.countDistinct(parts[0]).alias("n_reads"))


@query("select guide as name, full_seq as seq from lib")
def fasta_round_trip(spark, folder):
    path = _folder(spark, "fasta")
    formats.to_fasta(facts.guides(spark, folder), "guide", "full_seq").write.text(path)
    return formats.read_fasta(spark, path)


@query("select read_id, 'U' || umi as umi, guide_qual, original_name from rd where umi is not null and guide_qual is not null and original_name is not null")
def packed_names_round_trip(spark, folder):
    rows = facts.reads(spark, folder).filter("umi is not null and guide_qual is not null and original_name is not null")
    packed = rows.select("read_id", formats.encode_name("umi_guide", {"umi": F.concat(F.lit("U"), "umi")}).alias("name"))
    out = packed.select("read_id", formats.decode_name("umi_guide", F.col("name")).alias("a"))
    return out.select("read_id", "a.umi", "a.guide_qual", "a.original_name")


@query("select guide, count(*) as n from gr group by guide")
def snapshot_round_trip(spark, folder):
    root = _folder(spark, "snapshots")
    counted = facts.guided(spark, folder).groupBy("guide").agg(F.count("*").alias("n"))
    snapshots.record_snapshot({"guide_counts": counted}, root, "first", "counts per guide")
    copied = _folder(spark, "snapshot-copy")
    snapshots.copy_snapshot(spark, root, "first", copied)
    return snapshots.read_snapshot(spark, copied, "guide_counts", "first")


@query("select category, subcategory, count(*) as n from gr group by all")
def routed_sink_round_trip(spark, folder):
    path = _folder(spark, "routed")
    formats.write_routed(facts.guided(spark, folder).select("record_id", "guide", "category", "subcategory"), path, ["category", "subcategory"], ["guide", "record_id"])
    return spark.read.parquet(path).groupBy("category", "subcategory").agg(F.count("*").alias("n"))


@query("select record_id, details, case when category = 'wild type' then 'n/a' else coalesce(common_sequence_name, '') end as note from rec")
def text_records_round_trip(spark, folder):
    """Records as tab-separated text, in which n/a and empty texts stay texts."""
    path = _folder(spark, "records")
    rows = facts.records(spark, folder).select("record_id", "details", F.when(F.col("category") == "wild type", "n/a").otherwise(F.coalesce("common_sequence_name", F.lit(""))).alias("note"))
    rows.write.option("sep", "\t").option("emptyValue", "").csv(path)
    return formats.read_records(spark, path, "record_id long, details string, note string")


@query("select read_id, guide, seq from rd where seq is not null and qual is not null and guide is not null and guide_qual is not null")
def mates_in_step(spark, folder):
    """The guide read and the outcome read of every pair, each from a FASTQ file of its own."""
    rows = facts.reads(spark, folder).filter("seq is not null and qual is not null and guide is not null and guide_qual is not null").withColumn("name", F.col("read_id").cast("string"))
    mates = []
    for seq, qual in (("guide", "guide_qual"), ("seq", "qual")):
        path = _folder(spark, "mates")
        formats.to_fastq(rows, "name", seq, qual).write.text(path)
        mates.append(formats.read_fastq(spark, path.removeprefix("file://") + "/part-*"))
    return formats.lock_step(*mates).select(F.col("name").cast("long").alias("read_id"), F.col("r1.seq").alias("guide"), F.col("r2.seq").alias("seq"))


@query("select screen_name from collapsed_umis group by screen_name", "")
def pools_found(spark, folder):
    names = screens.discover(spark, table(spark, folder, "collapsed_umis"))
    return spark.createDataFrame([(n,) for n in names], "screen_name string")


@query("select screen, pool, screen || '_' || pool as name, count(*) as n from rec group by all")
def systematic_names(spark, folder):
    rows = facts.records(spark, folder)
    return rows.withColumn("name", formats.systematic_name(["screen", "pool"])).groupBy("screen", "pool", "name").agg(F.count("*").alias("n"))


@query("select substr(umi, 1, 8) as cell, umi, min(guide) as reference from rd where umi is not null and not contains(umi, 'N') group by umi having count(distinct guide) = 1")
def barcode_table(spark, folder):
    rows = facts.reads(spark, folder).filter("umi is not null").groupBy("umi").agg(F.collect_set("guide").alias("refs")).withColumn("cell", F.substring("umi", 1, 8))
    return formats.barcode_table(rows, "cell", "umi", "refs")


@query("select guide, name, value from (select guide, 'rank' as name, cast(rank as double) as value from lib union all select guide, 'gamma', gamma from lib)")
def wide_to_long(spark, folder):
    wide = facts.guides(spark, folder).select("guide", F.col("rank").cast("double").alias("rank"), "gamma")
    return formats.wide_to_long(wide, "guide", "name")


# -- streams -------------------------------------------------------------------


@query("""with exp as (select upper(trim(short_name)) as name, substr(upper(full_seq), 1, 45) as e from guide_library), ds as (select distinct upper(guide) as s from umi_reads),
near as (select s, name from ds join exp on length(s) = length(e) and substr(s, 1, 22) = substr(e, 1, 22) and hamming(s, e) <= 1 union select s, name from ds join exp on length(s) = length(e) and substr(s, 23) = substr(e, 23) and hamming(s, e) <= 1),
res as (select s, case when count(distinct name) = 1 then min(name) else 'unknown' end as g from near group by s)
select coalesce(g, 'unknown') as guide_name, count(*) as n from umi_reads left join res on upper(guide) = s group by 1""", "")
def stream_demultiplexed(spark, folder):
    """Reads as a stream of files, assigned as they arrive."""
    reads = table(spark, folder, "umi_reads")
    expected = facts.guides(spark, folder).select("guide", F.substring(F.upper("full_seq"), 1, 45).alias("expected"))
    stream = ST.stream_table(spark, f"{folder}/umi_reads.parquet*", reads.schema)
    out, state = _folder(spark, "stream"), _folder(spark, "stream-state")
    assigned = ST.demultiplex_stream(stream, F.substring("guide", 1, 45), D.resolver(expected, "guide", "expected"))
    ST.write_once(assigned.select("read_id", "guide_name"), out, state).awaitTermination()
    return spark.read.parquet(out).groupBy("guide_name").agg(F.count("*").alias("n"))


@query("select count(distinct read_id) as n from umi_reads", "")
def stream_distinct_records(spark, folder):
    reads = table(spark, folder, "umi_reads")
    stream = ST.stream_table(spark, f"{folder}/umi_reads.parquet*", reads.schema).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    out, state = _folder(spark, "distinct"), _folder(spark, "distinct-state")
    # a delivery may come at any time, so the watermark stays behind all of them
    ST.write_once(ST.distinct_records(stream, "read_id", "ingested_at", "3650 days").select("read_id"), out, state).awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events where ts < (select time_bucket(interval '1 hour', max(ts) - interval '1 hour') from events) group by all", "")
def stream_windowed_events(spark, folder):
    """Counts per hour; a window is written once the watermark has passed its end."""
    events = table(spark, folder, "events")
    stream = ST.stream_table(spark, f"{folder}/events.parquet*", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out, state = _folder(spark, "windows"), _folder(spark, "windows-state")
    ST.write_once(ST.windowed_counts(stream, "ts", ["event_type"], "1 hour"), out, state).awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
