"""Alignment files: round trips, order, routes, cut-off files."""

import gzip

import pytest
from pyspark.sql import functions as F

from tessera.sources import bam

RECORDS = "route string, name string, flag int, ref string, pos int, mapq int, cigar string, seq string, qual string"


def test_round_trip_with_nulls_and_odd_lengths(spark, tmp_path):
    rows = [
        ("a b/c", "r2", 16, "chr1", 41, 60, "3S10M2D1I", "ACGTNRYSWKMBDHV" * 6001, "F" * 90015),
        ("a b/c", "r1", 0, "chr2", 0, 0, "5M", "ACGTA", "!~IIF"),
        (None, "r3", 4, None, None, None, None, "", ""),
        ("x", "r4", None, None, None, None, "", "acgtn", None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    files = bam.write_bam(df, str(tmp_path), ["route"], ["name"], [("chr1", 1000), ("chr2", 500)])
    assert files.agg(F.sum("n")).first()[0] == 4
    got = {r.name: r for r in bam.read_bam(spark, str(tmp_path)).collect()}
    for r in rows:
        g = got[r[1]]
        assert (g.seq, g.qual if r[7] else "") == (r[7].upper(), r[8] if r[7] else "")
        assert (g.ref, g.pos, g.cigar or "") == (r[3], -1 if r[4] is None else r[4], r[6] or "")
    assert got["r4"].flag == 4 and got["r2"].flag == 16 and got["r2"].mapq == 60
    # the files are plain block gzip, whose blocks name their size
    data = next(tmp_path.rglob("*.bam")).read_bytes()
    assert gzip.decompress(data)[:4] == b"BAM\x01" and data.endswith(bam.END_OF_FILE) and data[12:16] == b"BC\x02\x00"


def test_a_large_route_has_several_sorted_files(spark, tmp_path):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("route"), F.format_string("n%04d", "id").alias("name"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"))
    files = bam.write_bam(df, str(tmp_path), ["route"], ["name"], records_per_file=100).collect()
    hot = sorted(f.path for f in files if "hot" in f.path)
    assert len(hot) >= 9 and max(f.n for f in files) <= 100 and sum(f.n for f in files) == 1000
    names = [[r[0] for r in bam.decode(open(p, "rb").read())] for p in hot]
    assert [n for part in names for n in part] == [f"n{i:04d}" for i in range(900)]


def test_cut_off_and_foreign_files(spark, tmp_path):
    df = spark.createDataFrame([("r", "q", 0, "c", 1, 1, "4M", "ACGT", "IIII")], RECORDS)
    path = bam.write_bam(df, str(tmp_path), ["route"], ["name"]).first().path
    data = open(path, "rb").read()
    with pytest.raises(ValueError, match="cut off"):
        list(bam.decode(data[: len(data) // 2]))
    with pytest.raises(ValueError, match="not a BAM"):
        list(bam.decode(gzip.compress(b"SAM\x01" + bytes(20))))


def test_names_and_merge(spark):
    rows = [("r", "a", 256, "d", 9, 1, "4M", "", ""), ("r", "a", 0, "t", 3, 1, "4M1D", "ACGT", "IIII"), ("r", "b", 0, "t", 1, 1, "2S4M", "ACGT", None)]
    df = spark.createDataFrame(rows, RECORDS)
    got = {r.name: r for r in bam.by_name(df).collect()}
    assert got["a"].seq == "ACGT" and [x.ref for x in got["a"].alignments] == ["d", "t"] and got["b"].qual is None
    assert sorted(r.name for r in bam.merged([("g1", df), ("g2", df)]).collect()) == sorted(f"{n}_{g}" for n in ("a", "a", "b") for g in ("g1", "g2"))
    assert [r[0] for r in df.select(bam.reference_length(F.col("cigar"))).collect()] == [4, 5, 4]
