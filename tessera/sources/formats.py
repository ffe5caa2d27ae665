"""Formats at the edge: FASTQ, FASTA, matrix market, packed names, sample sheets, barcode tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Layouts of packed names: field and kind (s text, a number is its width with leading zeros).
ANNOTATIONS = {
    "umi": [("umi", "s"), ("original_name", "s")],
    "umi_guide": [("umi", "s"), ("guide", "s"), ("guide_qual", "s"), ("original_name", "s")],
    "collapsed_umi": [("umi", "s"), ("guide", "s"), ("guide_qual", "s"), ("cluster_id", 6), ("num_reads", 6)],
    "collapsed_umi_mismatch": [("umi", "s"), ("cluster_id", 6), ("num_reads", 10), ("mismatch", 0)],
    "common_sequence": [("rank", 12), ("count", 12)],
    "read_with_guide": [("query_name", "s"), ("guide", "s"), ("guide_qual", "s")],
    "read_with_mismatches": [("query_name", "s"), ("mismatches", "s")],
    "archive": [("original_name", "s"), ("umi_seq", "s"), ("umi_qual", "s")],
}


def encode_name(layout: str, columns: dict[str, Column] | None = None, sep: str = "_") -> Column:
    """Columns packed into one name; numbers are padded with zeros, negative ones keep their sign."""
    parts = []
    for name, kind in ANNOTATIONS[layout]:
        col = (columns or {}).get(name, F.col(name))
        parts.append(col.cast("string") if kind == "s" else F.format_string(f"%0{kind}d" if kind else "%d", col.cast("long")))
    return F.concat_ws(sep, *parts)


def decode_name(layout: str, name: Column, sep: str = "_") -> Column:
    """A packed name as a struct of typed fields; a text that contains the separator must come last."""
    fields = ANNOTATIONS[layout]
    parts = F.split(name, sep, len(fields))
    return F.struct(*[(F.get(parts, F.lit(i)) if kind == "s" else F.get(parts, F.lit(i)).cast("long")).alias(field) for i, (field, kind) in enumerate(fields)])


class _Piece(InputPartition):
    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


class _FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        out: list[InputPartition] = []
        for p in sorted(glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path)):
            n = os.path.getsize(p)
            if p.endswith(".gz"):
                out.append(_Piece(p, 0, -1))
            else:
                out += [_Piece(p, a, min(n, a + self.size)) for a in range(0, n, self.size)]
        return out or [_Piece("", 0, 0)]

    def read(self, partition):
        import gzip

        if not partition.path:
            return
        with (gzip.open if partition.path.endswith(".gz") else open)(partition.path, "rb") as f:
            if partition.start > 0:
                # a record starts at a line with @ whose line after next starts with +
                f.seek(partition.start - 1)
                if f.read(1) != b"\n":
                    f.readline()
                while True:
                    at = f.tell()
                    a, _, c = f.readline(), f.readline(), f.readline()
                    if not a or (a[:1] == b"@" and c[:1] == b"+"):
                        f.seek(at)
                        break
                    f.seek(at)
                    f.readline()
            while partition.stop < 0 or f.tell() < partition.stop:
                head = f.readline()
                if not head:
                    return
                seq, plus, qual = (f.readline().rstrip(b"\r\n").decode("ascii") for _ in range(3))
                if head[:1] != b"@" or plus[:1] != "+" or len(seq) != len(qual):
                    raise ValueError(f"{partition.path}: not a FASTQ record: {head[:60]!r}")
                yield head[1:].split()[0].decode("ascii") if head[1:].split() else "", seq, qual


class FastqSource(DataSource):
    """``spark.read.format('fastq').load(path)``: name (up to the first blank), seq, qual.

    Plain files are split by bytes, gzip files are one partition each.  Paths
    must be readable on all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "name string, seq string, qual string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").load(path)


def lock_step(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Mates of reads by name; a name that is not in all of them raises an error when it is read."""
    out = first.select("name", F.struct("seq", "qual").alias("r1"))
    for i, other in enumerate(others, 2):
        out = out.join(other.select("name", F.struct("seq", "qual").alias(f"r{i}")), "name", "full_outer")
    complete = None
    for i in range(1, len(others) + 2):
        complete = F.col(f"r{i}").isNotNull() if complete is None else complete & F.col(f"r{i}").isNotNull()
    checked = F.when(complete, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("mates out of step at "), F.col("name"))))
    return out.withColumn("name", checked.cast("string"))


def to_fastq(reads: DataFrame, name: str = "name", seq: str = "seq", qual: str = "qual") -> DataFrame:
    """One text column with four lines a read, to be written as text."""
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col(name)), F.col(seq), F.lit("+"), F.col(qual)).alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq``; the records of a file may have any number of lines."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim(F.regexp_replace("value", r"\s", ""))) > 0)
    lines = F.split("value", r"\r?\n", 2)
    return records.select(F.split(lines[0], r"\s+")[0].alias("name"), F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def to_fasta(df: DataFrame, name: str, seq: str) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value"))


def read_matrix_market(spark: SparkSession, prefix: str) -> DataFrame:
    """``cell, feature, n`` from ``prefix.mtx``, ``prefix.barcodes.txt`` and ``prefix.genes.txt``."""
    # the first line that is no comment names the sizes
    lines = spark.sparkContext.textFile(f"{prefix}.mtx").filter(lambda x: not x.startswith("%")).zipWithIndex().filter(lambda x: x[1] > 0).map(lambda x: (x[0],))
    parts = F.split(F.trim("value"), r"\s+")
    cells, features = (_numbered(spark, f"{prefix}.{x}.txt") for x in ("barcodes", "genes"))
    body = spark.createDataFrame(lines, "value string").select(parts[0].cast("int").alias("row"), parts[1].cast("int").alias("col"), parts[2].cast("double").alias("n"))
    return body.join(cells.select(F.col("i").alias("row"), F.col("value").alias("cell")), "row").join(features.select(F.col("i").alias("col"), F.col("value").alias("feature")), "col").select("cell", "feature", F.col("n").cast("long").alias("n"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1] + 1, x[0]))
    return spark.createDataFrame(rows, "i int, value string")


def barcode_table(reads: DataFrame, cell: str, umi: str, references: str) -> DataFrame:
    """Rows with called bases only whose alignments name one reference: ``cell, umi, reference``."""
    unique = F.array_distinct(F.col(references))
    return reads.filter(~F.col(cell).contains("N") & ~F.col(umi).contains("N") & (F.size(unique) == 1)).select(F.col(cell).alias("cell"), F.col(umi).alias("umi"), unique[0].alias("reference"))


def read_sheet(spark: SparkSession, path: str, lists: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """A sample sheet: empty cells are null, list columns are split at ``;``."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.withColumns({c: F.split(c, ";") for c in lists if c in df.columns})


def systematic_name(fields: list[str], manual: str | None = None) -> Column:
    """Fields joined by ``_``; an error names a missing field or a manual name that disagrees."""
    joined = F.concat_ws("_", *fields)
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    checked = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing: "), F.array_join(missing, ", "))).cast("string"))
    if manual:
        checked = checked.when(F.col(manual).isNotNull() & (F.col(manual) != joined), F.raise_error(F.concat(F.lit("disagrees with "), F.col(manual))).cast("string"))
    return checked.otherwise(joined)


def write_routed(df: DataFrame, path: str, keys: list[str], order: list[str], max_records: int = 5_000_000) -> None:
    """One folder per key value, rows in order inside every file, no file above ``max_records``."""
    df.repartition(*keys).sortWithinPartitions(*keys, *order).write.partitionBy(*keys).option("maxRecordsPerFile", max_records).mode("overwrite").parquet(path)


def wide_to_long(df: DataFrame, key: str, name: str = "guide", value: str = "value") -> DataFrame:
    """A table with one column per label as rows."""
    return df.unpivot([key], [c for c in df.columns if c != key], name, value)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Tab-separated records in which 'n/a' and empty texts stay texts; a text file knows no null."""
    df = spark.read.schema(schema).option("sep", "\t").option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return df.fillna("", [c for c, kind in df.dtypes if kind == "string"])


def write_selection(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)
