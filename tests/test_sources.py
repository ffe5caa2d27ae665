import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from tessera.sources import formats, screens, snapshots
from tessera.streaming import demultiplex


def test_fastq_split_and_gzip(spark, tmp_path):
    text = "".join(f"@r{i} extra\n{'ACGT' * (i % 5 + 1)}\n+\n{'@III' * (i % 5 + 1)}\n" for i in range(500))
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    spark.dataSource.register(formats.FastqSource)
    df = spark.read.format("fastq").option("splitBytes", 777).load(str(tmp_path))
    got = df.groupBy("name").count().collect()
    assert len(got) == 500 and all(r["count"] == 2 for r in got)
    assert df.filter("length(seq) <> length(qual)").count() == 0


def test_broken_fastq_is_an_error(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="FASTQ"):
        formats.read_fastq(spark, str(tmp_path / "a.fastq")).collect()


def test_mates_out_of_step(spark):
    a = spark.createDataFrame([("x", "A", "I"), ("y", "C", "I")], "name string, seq string, qual string")
    assert formats.lock_step(a, a).count() == 2
    with pytest.raises(Exception, match="out of step"):
        formats.lock_step(a, a.filter("name = 'x'")).collect()


def test_packed_names(spark):
    df = spark.createDataFrame([("ACGT", 3, 12, -1)], "umi string, cluster_id int, num_reads int, mismatch int")
    name = df.select(formats.encode_name("collapsed_umi_mismatch").alias("n"))
    assert name.first().n == "ACGT_000003_0000000012_-1"
    back = name.select(formats.decode_name("collapsed_umi_mismatch", F.col("n")).alias("a")).first().a
    assert (back.umi, back.cluster_id, back.num_reads, back.mismatch) == ("ACGT", 3, 12, -1)


def test_matrix_market(spark, tmp_path):
    (tmp_path / "c.mtx").write_text("%%MatrixMarket\n2 3 2\n1 1 5\n2 3 7\n")
    (tmp_path / "c.barcodes.txt").write_text("AA\nCC\n")
    (tmp_path / "c.genes.txt").write_text("g1\ng2\ng3\n")
    assert sorted(map(tuple, formats.read_matrix_market(spark, str(tmp_path / "c")).collect())) == [("AA", "g1", 5), ("CC", "g3", 7)]


def test_sheet_and_screens(spark, tmp_path):
    (tmp_path / "s.csv").write_text("screen_name,has_UMIs,pools_to_merge,min_reads_per_UMI\nb,False,,\na,True,x;y,2\n")
    got = screens.screens_from_sheet(formats.read_sheet(spark, str(tmp_path / "s.csv"), ("pools_to_merge",)))
    assert [s.name for s in got] == ["a", "b"] and got[0].pools == ("x", "y") and got[0].is_merged and got[0].min_reads_per_umi == 2 and not got[1].has_umis and got[1].min_reads_per_umi == 4
    assert screens.blunt_insertion_limit(258, 120) == 133


def test_systematic_name(spark):
    df = spark.createDataFrame([("a", "b", None), ("a", "b", "a_b"), ("a", "b", "c"), (None, "b", None)], "x string, y string, m string")
    name = formats.systematic_name(["x", "y"], "m")
    assert [r.n for r in df.filter("x = 'a' and (m is null or m = 'a_b')").select(name.alias("n")).collect()] == ["a_b", "a_b"]
    for bad, message in (("m = 'c'", "disagrees"), ("x is null", "missing: x")):
        with pytest.raises(Exception, match=message):
            df.filter(bad).select(name.alias("n")).collect()


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    df = spark.range(3)
    snapshots.record_snapshot({"t": df}, root, "one", now=dt.datetime(2024, 1, 1))
    snapshots.record_snapshot({"t": df.filter("id > 0")}, root, "two", now=dt.datetime(2024, 1, 2))
    assert [r.name for r in snapshots.list_snapshots(spark, root).collect()] == ["one", "two"]
    assert snapshots.read_snapshot(spark, root, "t", "two").count() == 2
    assert snapshots.read_snapshot(spark, root, "t", "2024-01-01_000000").count() == 3
    with pytest.raises(ValueError, match="0 snapshots"):
        snapshots.resolve_snapshot(spark, root, "three")
    snapshots.record_snapshot({"t": df}, root, "one", now=dt.datetime(2024, 1, 3))
    with pytest.raises(ValueError, match="2 snapshots"):
        snapshots.resolve_snapshot(spark, root, "one")


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a some words\nACGT\nAC\n>b\nGG\n")
    assert sorted(map(tuple, formats.read_fasta(spark, str(tmp_path / "x.fa")).collect())) == [("a", "ACGTAC"), ("b", "GG")]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    spark.range(5).write.parquet(src)
    for total in (5, 12):
        demultiplex.write_once(demultiplex.stream_table(spark, src, "id long"), out, state).awaitTermination()
        assert spark.read.parquet(out).count() == total
        spark.range(7).write.mode("append").parquet(src)


def test_an_entry_may_equal_the_size_line(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n2 2 2\n1 1 5\n2 2 2\n")
    (tmp_path / "m.barcodes.txt").write_text("c1\nc2\n")
    (tmp_path / "m.genes.txt").write_text("g1\ng2\n")
    assert sorted(tuple(r) for r in formats.read_matrix_market(spark, str(tmp_path / "m")).collect()) == [("c1", "g1", 5), ("c2", "g2", 2)]
