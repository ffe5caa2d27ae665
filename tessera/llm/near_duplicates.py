"""Groups of reads of one molecule: nearly the same barcode and nearly the same sequence.

Two reads are linked if they share the scope (quartet), their barcodes have the
same length and differ in at most one place, and the Jaccard similarity of
their 8-letter substrings reaches the threshold.  Barcodes that differ in at
most one place agree in their first or their second half, so a read stands in
two buckets (scope, half, letters of that half).  Within a bucket candidates
are reads that share a band of their circulant MinHash signature, and every
candidate is verified exactly.  A bucket above ``BUCKET_ROWS`` is split by its
bands before anything is gathered; exact copies are first reduced to one row,
and a band that is still too large is tiled, every pair of its blocks being one
bucket.  No bucket is ever cut off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.folding import fold_dna, fold_name
from tessera.llm.shingles import circulant_minhash, dna_shingles, intersection_sizes, least_labels, run_pairs, string_bytes
from tessera.operators.components import connected_components
from tessera.session import materialize

WIDTH = 8
THRESHOLD = 0.5
#: One coordinate a band: at similarity 0.5 a pair shares none of 14 with probability 2^-14.
BANDS = 14
BUCKET_ROWS = 1024
#: Rows that a Python worker gathers before it works on them.
GATHER_ROWS = 40_000
GATHER_BYTES = 48 << 20

_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_COLUMNS = ["bucket", "scope", "half", "side", "rid", "umi", "seq"]


def _barcode_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = string_bytes(column)
    return offsets, data


def _close_barcodes(offsets: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every pair with barcodes of one length: the number of differing places and whether the first halves agree."""
    size = np.diff(offsets)
    differ, first = np.full(len(a), 99, np.int64), np.zeros(len(a), bool)
    for length in np.unique(size[a]):
        rows = np.flatnonzero((size[a] == length) & (size[b] == length))
        step = max(1, (1 << 22) // max(1, int(length)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            cols = np.arange(length)
            unequal = data[offsets[a[part]][:, None] + cols] != data[offsets[b[part]][:, None] + cols]
            differ[part] = unequal.sum(axis=1)
            first[part] = ~unequal[:, : length // 2].any(axis=1)
    return differ, first


def _links(rows: pa.Table, threshold: float, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the buckets of ``rows``, as read ids."""
    rid = rows.column("rid").to_numpy()
    bucket = np.unique(rows.column("bucket").to_numpy(), return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((rid, bucket))
    # deliveries of one read stand next to each other: one is enough
    keep = np.concatenate([[True], (bucket[order][1:] != bucket[order][:-1]) | (rid[order][1:] != rid[order][:-1])])
    order = order[keep]
    count = np.bincount(bucket[order], minlength=int(bucket.max()) + 1)
    order = order[count[bucket[order]] > 1]
    if not len(order):
        return rid[:0], rid[:0]
    rows = rows.take(pa.array(order)).combine_chunks()
    rid, bucket = rid[order], bucket[order]
    scope, half, side = (rows.column(c).to_numpy() for c in ("scope", "half", "side"))
    u_off, u_data = string_bytes(rows.column("umi").chunk(0))
    s_off, s_data = string_bytes(rows.column("seq").chunk(0))
    offsets, codes = dna_shingles(s_off, s_data, WIDTH)
    size = np.diff(offsets)
    n = len(rid)
    sig = circulant_minhash(offsets, codes, bands)
    pairs = np.zeros(0, np.int64)
    for band in range(bands):
        rows_in = np.flatnonzero(size > 0)
        key = (bucket[rows_in] << 25) | sig[rows_in, band].astype(np.int64)
        sort = np.argsort(key, kind="stable")
        x, y = run_pairs(key[sort])
        x, y = rows_in[sort[x]], rows_in[sort[y]]
        pairs = np.union1d(pairs, np.minimum(x, y) * n + np.maximum(x, y))
    a, b = pairs // n, pairs % n
    ok = (scope[a] == scope[b]) & ((side[a] == 0) | (side[a] != side[b]))
    a, b = a[ok], b[ok]
    differ, first = _close_barcodes(u_off, u_data, a, b)
    # a pair whose first halves agree belongs to the bucket of the first half
    ok = (differ <= 1) & ((half[a] == 0) | ~first)
    a, b = a[ok], b[ok]
    common = intersection_sizes(offsets, codes, a, b)
    ok = common >= threshold * (size[a] + size[b] - common)
    a, b = a[ok], b[ok]
    root = least_labels(n, a, b)
    leaf = np.flatnonzero(root != np.arange(n))
    return rid[leaf], rid[root[leaf]]


def _bucket_links(threshold: float, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within the buckets of a partition that is sorted by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            a, b = _links(table, threshold, bands)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_SCHEMA)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < GATHER_ROWS and sum(x.nbytes for x in held) < GATHER_BYTES:
                continue
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if (bucket != bucket[-1]).any() else 0
            if cut:  # the last bucket may go on
                yield out(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield out(pa.Table.from_batches(held))

    return work


def _band_values(bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_bytes(batch.column("seq"))
            sig = circulant_minhash(*dna_shingles(offsets, data, WIDTH), bands)
            values = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, bands, dtype=np.int32), pa.array(sig.reshape(-1).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "bands"])

    return work


def _split_hot(hot_rows: DataFrame, bucket_rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Rows of oversized buckets in buckets of bounded size, and the links of exact copies."""
    same = ["bucket", "scope", "half", "umi", "seq"]
    kept = hot_rows.groupBy(*same).agg(F.min("rid").alias("rid"))
    # a copy has all 8-letter substrings in common with the one kept, if there are any
    copies = hot_rows.filter(F.length("seq") >= WIDTH).join(kept.withColumnRenamed("rid", "keep"), same).filter("rid <> keep").select(F.col("rid").alias("a"), F.col("keep").alias("b"))
    ddl = "bucket long, scope int, half int, umi string, seq string, rid long, bands array<long>"
    banded = kept.select("bucket", "scope", "half", "umi", "seq", "rid").mapInArrow(_band_values(bands), ddl)
    parts = banded.select("scope", "half", "umi", "seq", "rid", "bucket", F.posexplode("bands").alias("band", "value"))
    parts = materialize(parts.withColumn("bucket", F.xxhash64("bucket", "band", "value")).drop("band", "value"), "hot-bands")
    tiles = parts.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(bucket_rows)).cast("int").alias("tiles"))
    block = F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int")
    tiled = parts.join(tiles, "bucket").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    # the diagonal tile holds its block alone; the others compare two blocks with each other
    out = tiled.select(F.when(F.col("tiles") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", low, high)).alias("bucket"), "scope", "half", side.cast("int").alias("side"), "rid", "umi", "seq")
    return out, copies


def molecule_links(reads: DataFrame, read_id: str = "read_id", scope: str = "quartet_name", barcode: str = "umi", sequence: str = "seq", threshold: float = THRESHOLD, bands: int = BANDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``a, b``: links that connect exactly the reads of one group.

    Reads with a null id, barcode or sequence have no link, nor has a sequence
    shorter than eight letters, which shares no substring with any other.  A
    null scope is a scope of its own.  Repeated rows of an id count once.
    Columns besides the four named ones are not read.
    """
    base = reads.select(F.col(read_id).cast("long").alias("rid"), F.coalesce(fold_name(F.col(scope)), F.lit("\x00")).alias("q"), fold_dna(barcode).alias("umi"), fold_dna(sequence).alias("seq")).filter("rid is not null and umi is not null and length(seq) >= 8")
    cut = F.floor(F.length("umi") / 2).cast("int")
    halves = F.array(*[F.struct(F.lit(h).alias("half"), text.alias("text")) for h, text in enumerate((F.substring(F.col("umi"), F.lit(1), cut), F.substring(F.col("umi"), cut + 1, F.length("umi"))))])
    rows = base.select("*", F.explode(halves).alias("h")).select(F.xxhash64("q", "h.half", F.length("umi"), "h.text").alias("bucket"), F.hash("q").alias("scope"), F.col("h.half").alias("half"), F.lit(0).alias("side"), "rid", "umi", "seq")
    hot = materialize(rows.groupBy("bucket").count().filter(F.col("count") > bucket_rows).select("bucket"), "hot-buckets")
    cold, links = rows, None
    if hot.limit(1).count():
        parts, links = _split_hot(rows.join(hot, "bucket", "left_semi"), bucket_rows, bands)
        cold = rows.join(hot, "bucket", "left_anti").select(*_COLUMNS).unionByName(parts.select(*_COLUMNS))
    found = cold.select(*_COLUMNS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links(threshold, bands), "a long, b long")
    return found if links is None else found.unionByName(links)


def molecule_groups(reads: DataFrame, **options) -> DataFrame:
    """``read_id, group_id`` of every read that is linked; the group is its least read id."""
    links = molecule_links(reads, **options)
    return connected_components(links, "a", "b", "molecules").select(F.col("node").alias("read_id"), F.col("component").alias("group_id"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of a group, the smaller id first; the number of pairs is what the result asks for."""
    a, b = groups.select("group_id", F.col("read_id").alias("read_id_a")), groups.select("group_id", F.col("read_id").alias("read_id_b"))
    return a.join(b, "group_id").filter("read_id_a < read_id_b").select("read_id_a", "read_id_b")
