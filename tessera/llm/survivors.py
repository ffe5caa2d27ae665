"""One surviving record for every group of duplicates, field by field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shingles import string_bytes

#: Parts into which the rows of a group are spread before its best row is chosen.
SALTS = 64


def best_rows(df: DataFrame, group: str, order: list[Column], tie: str, salts: int = SALTS) -> DataFrame:
    """The first row of every group by ``order``, ties broken by the smallest ``tie``.

    A group may hold any share of the rows: its rows are first ranked within
    salted parts, then the winners of the parts among themselves.  A null group
    is a group; with all ranks equal the smallest tie-breaker wins.  An empty
    table gives no row.
    """
    keys = [*order, F.col(tie).asc_nulls_last()]
    part = F.pmod(F.xxhash64(tie), F.lit(salts))
    first = df.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*keys))).filter("_rank = 1").drop("_part")
    return first.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*keys))).filter("_rank = 1").drop("_rank")


def _row_sums(column: pa.Array, value: np.ndarray) -> np.ndarray:
    """For every text the sum of ``value`` over its bytes."""
    offsets, data = string_bytes(column)
    return np.diff(np.concatenate([[0], np.cumsum(value[data])])[offsets])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    called, uncalled, phred = np.zeros(256, np.int64), np.zeros(256, np.int64), np.arange(256, dtype=np.int64) - 33
    called[np.frombuffer(b"ACGTacgt", np.uint8)] = 1
    uncalled[np.frombuffer(b"Nn", np.uint8)] = 1
    for batch in batches:
        missing = np.asarray(batch.column("qual").is_null())
        yield pa.RecordBatch.from_arrays(
            [batch.column("read_id"), pa.array(_row_sums(batch.column("seq"), called)), pa.array(_row_sums(batch.column("qual"), phred), mask=missing), pa.array(_row_sums(batch.column("umi"), uncalled)), batch.column("recency")],
            names=["read_id", "called", "phred", "uncalled", "recency"],
        )


def read_features(reads: DataFrame) -> DataFrame:
    """What the choice among the reads of a molecule needs, per row.

    Completeness is the number of A, C, G, T in ``seq`` and of N in ``umi``,
    trust the sum of phred + 33 scores in ``qual`` (null for null), recency
    ``sequenced_at`` in microseconds.
    """
    rows = reads.select("read_id", "umi", "seq", "qual", F.unix_micros(F.col("sequenced_at").cast("timestamp")).alias("recency"))
    return rows.mapInArrow(_features, "read_id long, called long, phred long, uncalled long, recency long")


def surviving_reads(reads: DataFrame, groups: DataFrame, salts: int = SALTS) -> DataFrame:
    """``group_read_id, seq_read_id, umi_read_id`` for every group of two or more reads.

    ``seq`` and ``qual`` are taken from the read with the most called bases,
    then the highest phred sum (null lowest), then the latest time (null
    earliest), then the smallest id; ``umi`` from the read with the fewest N,
    then the latest time, then the smallest id.
    """
    rows = read_features(reads.filter("read_id is not null and umi is not null and seq is not null")).join(groups, "read_id")
    by_seq = best_rows(rows, "group_id", [F.col("called").desc_nulls_last(), F.col("phred").desc_nulls_last(), F.col("recency").desc_nulls_last()], "read_id", salts)
    by_umi = best_rows(rows, "group_id", [F.col("uncalled").asc_nulls_last(), F.col("recency").desc_nulls_last()], "read_id", salts)
    return by_seq.select(F.col("group_id").alias("group_read_id"), F.col("read_id").alias("seq_read_id")).join(by_umi.select(F.col("group_id").alias("group_read_id"), F.col("read_id").alias("umi_read_id")), "group_read_id")
