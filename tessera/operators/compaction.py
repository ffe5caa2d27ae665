"""Packing many small files into indexed archive containers.

The store holds one small file per (group, number), for example per quartet
and chunk.  Its records are packed, as the bytes of one JSON line each, into
large blocks.  A block row carries the payload and the entries of its members:
path, segment, offset, length, number of records and checksum.  A file of any
size is held as segments of at most one block, so neither a task nor a block
grows with it.  Readers prune to the entries to look a file up, and read blocks
in parallel.  The tasks that pack are as many as the bytes ask for.

:func:`pack_stored_files` packs files of a file system as they are, byte by byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.folding import fold_name
from tessera.session import materialize

#: Target bytes of a block's payload before Parquet compression.
BLOCK_BYTES = 64 << 20
#: Bytes of records that one task packs, so that it sorts in memory; a task writes one file of blocks.
TASK_BYTES = 24 << 20
#: Bytes of a JSON line besides the text columns, per column: name, quotes, a number or a time.
COLUMN_BYTES = 40
#: A list of repeated records is broadcast up to this many rows (about 60 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000

_MEMBER = pa.struct([("grp", pa.string()), ("num", pa.int32()), ("segment", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("n_records", pa.int64()), ("n_repeated", pa.int64()), ("crc32", pa.int64())])
_BLOCK = pa.schema([("block_id", pa.string()), ("n_bytes", pa.int64()), ("members", pa.list_(_MEMBER)), ("payload", pa.binary())])
_BLOCK_DDL = "block_id string, n_bytes long, members array<struct<grp:string,num:int,segment:int,offset:bigint,length:bigint,n_records:bigint,n_repeated:bigint,crc32:bigint>>, payload binary"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and the bytes of a string column without nulls."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return offsets.astype(np.int64), memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")


def _packer(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        payload, members, blocks = bytearray(), [], 0
        last_row, last_path, segment = None, None, 0

        def flush() -> pa.RecordBatch:
            nonlocal payload, members, blocks
            row = {"block_id": f"{part:06d}-{blocks:06d}", "n_bytes": len(payload), "members": members, "payload": bytes(payload)}
            payload, members, blocks = bytearray(), [], blocks + 1
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            if not batch.num_rows:
                continue
            # a record that stands in a chunk more than once is held once: its copies are neighbours
            ident = pc.binary_join_element_wise(pc.fill_null(batch.column("grp"), "\x00"), pc.fill_null(pc.cast(batch.column("num"), pa.string()), "\x00"), batch.column("record"), "\x01")
            same = np.asarray(pc.fill_null(pc.equal(ident.slice(1), ident.slice(0, len(ident) - 1)), False)) if len(ident) > 1 else np.zeros(0, bool)
            keep = np.concatenate([[ident[0].as_py() != last_row], ~same])
            last_row = ident[len(ident) - 1].as_py()
            batch = batch.filter(pa.array(keep))
            if not batch.num_rows:
                continue
            offsets, data = _bytes_of(batch.column("line"))
            repeated = np.concatenate([[0], np.cumsum(np.asarray(batch.column("repeated")))])
            grp = np.asarray(pc.fill_null(batch.column("grp").dictionary_encode(null_encoding="encode").indices, -1))
            num = np.asarray(pc.fill_null(batch.column("num"), -(2**31)))
            cut = np.flatnonzero((grp[1:] != grp[:-1]) | (num[1:] != num[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                path = (batch.column("grp")[a].as_py(), batch.column("num")[a].as_py())
                if path != last_path:
                    last_path, segment = path, 0
                while a < b:
                    room = block_bytes - len(payload)
                    e = min(b, int(np.searchsorted(offsets, offsets[a] + room, "right")) - 1)
                    if e <= a:
                        if payload:
                            yield flush()
                            continue
                        e = a + 1  # one record that is larger than a block
                    piece = data[offsets[a] : offsets[e]]
                    members.append({"grp": path[0], "num": path[1], "segment": segment, "offset": len(payload), "length": len(piece), "n_records": e - a, "n_repeated": int(repeated[e] - repeated[a]), "crc32": zlib.crc32(piece)})
                    payload += piece
                    segment, a = segment + 1, e
                    if len(payload) >= block_bytes:
                        yield flush()
        if members:
            yield flush()

    return pack


@dataclass
class Archive:
    """A packed store: the blocks, the index of its members and the row count of every file."""

    blocks: DataFrame
    files: DataFrame
    record_schema: T.StructType

    def index(self) -> DataFrame:
        """One row per stored segment; reads no payload."""
        return self.blocks.select("block_id", F.explode("members").alias("m")).select("block_id", "m.*")

    def records(self, spark=None) -> DataFrame:
        """All records again, each once, after every checksum was compared."""
        lines = self.blocks.mapInArrow(_unpack, "line string")
        return lines.select(F.from_json("line", self.record_schema, _JSON).alias("r")).select("r.*")

    def manifest(self) -> DataFrame:
        """Per file: rows and distinct records in the store, records held, records that are repeated anywhere.

        ``grp, num, n_rows, n_ids, n_held, n_repeated``.
        """
        held = self.index().groupBy("grp", "num").agg(F.sum("n_records").alias("n_held"), F.sum("n_repeated").alias("n_repeated"))
        both = self.files.alias("f").join(held.alias("h"), F.col("f.grp").eqNullSafe(F.col("h.grp")) & F.col("f.num").eqNullSafe(F.col("h.num")), "left")
        return both.select("f.grp", "f.num", "f.n_rows", "f.n_ids", F.coalesce("n_held", F.lit(0)).alias("n_held"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"))


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            for m in row["members"]:
                piece = row["payload"][m["offset"] : m["offset"] + m["length"]]
                if zlib.crc32(piece) != m["crc32"]:
                    raise ValueError(f"checksum of {m['grp']}/{m['num']} in block {row['block_id']} does not match")
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in piece.split(b"\n")[:-1]], pa.string())], ["line"])


def stored_bytes(rows: DataFrame) -> int:
    """About the bytes of the JSON lines of all rows, from one pass over the lengths of the text columns."""
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    size = F.lit(COLUMN_BYTES * len(rows.columns)).cast("long")
    for c in texts:
        size = size + F.coalesce(F.octet_length(f"`{c}`"), F.lit(0))
    return int(rows.agg(F.sum(size)).first()[0] or 0)


def pack_files(rows: DataFrame, group: str, number: str, record_id: str, order: list[str], block_bytes: int = BLOCK_BYTES, broadcast_rows: int = BROADCAST_ROWS, task_bytes: int = TASK_BYTES) -> Archive:
    """Pack ``rows`` into containers that hold every record exactly once.

    A record is a ``record_id``.  Of a repeated record the row that comes first
    by ``order``, then file, then content is kept, in its own file.  A row
    without an id is a record by its content.  Files are (``group`` folded,
    ``number``); null parts name a file of their own.  All columns are packed
    except none; nulls, empty and long texts come back as they were.  An empty
    table gives an archive without blocks.
    """
    schema = rows.schema
    line = F.concat(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), _JSON), F.lit("\n"))
    base = rows.select(fold_name(F.col(group)).alias("grp"), F.col(number).cast("int").alias("num"), F.col(record_id).alias("rid"), F.struct(*[F.col(c) for c in order]).alias("ord"), line.alias("line"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("content"))
    slim = rows.select(fold_name(F.col(group)).alias("grp"), F.col(number).cast("int").alias("num"), F.col(record_id).alias("rid"), F.struct(*[F.col(c) for c in order]).alias("ord"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("content"))
    first = F.min(F.struct("ord", "grp", "num", "content"))
    repeated = materialize(
        slim.filter("rid is not null").groupBy("rid").agg(F.count("*").alias("n"), first.alias("k")).filter("n > 1").select("rid", F.col("k.grp").alias("k_grp"), F.col("k.num").alias("k_num"), F.col("k.content").alias("k_content")),
        "repeated",
    )
    small = repeated.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = base.join(F.broadcast(repeated) if small else repeated, "rid", "left")
    kept = joined.filter(F.col("k_content").isNull() | (F.col("k_grp").eqNullSafe(F.col("grp")) & F.col("k_num").eqNullSafe(F.col("num")) & (F.col("k_content") == F.col("content"))))
    record = F.coalesce(F.col("rid").cast("string"), F.concat(F.lit("="), F.col("content").cast("string")))
    ranged = kept.select("grp", "num", record.alias("record"), F.col("k_content").isNotNull().cast("int").alias("repeated"), "line")
    # a stated number of partitions is not put together again by size
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-stored_bytes(rows) // task_bytes))
    ranged = ranged.repartitionByRange(tasks, "grp", "num", "record").sortWithinPartitions("grp", "num", "record")
    blocks = materialize(ranged.mapInArrow(_packer(block_bytes), _BLOCK_DDL), "archive")
    keys = slim.select("grp", "num", "rid")
    again = keys.join(F.broadcast(repeated.select("rid")) if small else repeated.select("rid"), "rid", "left_semi").groupBy("grp", "num", "rid").agg((F.count("*") - 1).alias("extra"))
    again = again.filter("extra > 0").groupBy("grp", "num").agg((-F.sum("extra")).alias("n_ids"), F.lit(0).cast("long").alias("n_rows"))
    files = keys.groupBy("grp", "num").agg(F.count("*").alias("n_ids"), F.count("*").alias("n_rows"))
    files = files.unionByName(again).groupBy("grp", "num").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_ids").alias("n_ids"))
    return Archive(blocks, files, schema)


_STORED_MEMBER = pa.struct([("path", pa.string()), ("segment", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("crc32", pa.int64())])
_STORED = pa.schema([("block_id", pa.string()), ("n_bytes", pa.int64()), ("members", pa.list_(_STORED_MEMBER)), ("payload", pa.binary())])
_STORED_DDL = "block_id string, n_bytes long, members array<struct<path:string,segment:int,offset:bigint,length:bigint,crc32:bigint>>, payload binary"


def _byte_packer(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, blocks = TaskContext.get().partitionId(), 0
        payload, members = bytearray(), []

        def flush() -> pa.RecordBatch:
            nonlocal payload, members, blocks
            row = {"block_id": f"{part:06d}-{blocks:06d}", "n_bytes": len(payload), "members": members, "payload": bytes(payload)}
            payload, members, blocks = bytearray(), [], blocks + 1
            return pa.RecordBatch.from_pylist([row], schema=_STORED)

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                data, segment, at = memoryview(content.as_buffer()), 0, 0
                while at < len(data) or segment == 0:
                    if len(payload) >= block_bytes:
                        yield flush()
                    piece = data[at : at + block_bytes - len(payload)]
                    members.append({"path": path.as_py(), "segment": segment, "offset": len(payload), "length": len(piece), "crc32": zlib.crc32(piece)})
                    payload += piece
                    at, segment = at + len(piece), segment + 1
        if members:
            yield flush()

    return pack


def pack_stored_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Written blocks ``block_id, n_bytes, members, payload`` with the original bytes of all files that ``path`` names, globs included.

    A file is held once, as one or more segments with path, offset, length and
    checksum.  The reader does not list files without bytes, which have nothing to
    hold.  A folder without files gives no block.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    size = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-int(size) // task_bytes))
    ranged = files.select("path", "content").repartitionByRange(tasks, "path").sortWithinPartitions("path")
    return materialize(ranged.mapInArrow(_byte_packer(block_bytes), _STORED_DDL), "stored-files")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            for m in row["members"]:
                piece = row["payload"][m["offset"] : m["offset"] + m["length"]]
                if zlib.crc32(piece) != m["crc32"]:
                    raise ValueError(f"checksum of {m['path']} in block {row['block_id']} does not match")
                yield pa.RecordBatch.from_arrays([pa.array([m["path"]]), pa.array([m["segment"]], pa.int32()), pa.array([piece], pa.binary())], ["path", "segment", "content"])


def stored_segments(blocks: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``path, segment, content`` of packed files, after every checksum was compared; only blocks that hold one of ``paths`` are read if these are given."""
    if paths is not None:
        wanted = blocks.select("block_id", F.explode("members.path").alias("path")).join(paths.select("path"), "path", "left_semi").select("block_id").distinct()
        blocks = blocks.join(wanted, "block_id", "left_semi")
    out = blocks.mapInArrow(_checked, "path string, segment int, content binary")
    return out if paths is None else out.join(paths.select("path"), "path", "left_semi")


def file_report(archive: Archive, listing: DataFrame, group: str, number: str, declared: str) -> DataFrame:
    """Every file of the store or the listing, and whether it can be carried over as it is.

    ``grp, num, n_rows, n_held, n_declared, is_repeated, is_miscounted,
    is_missing, as_is``.  Repeated: one of its records stands in more than one
    row of the store.  Miscounted: its distinct records differ from the declared
    number; a null number differs.  Missing: not in both.  Listed copies of one
    file that disagree count with the largest number.
    """
    manifest = archive.manifest()
    listed = listing.groupBy(fold_name(F.col(group)).alias("grp"), F.col(number).cast("int").alias("num")).agg(F.max(declared).cast("long").alias("n_declared"), F.lit(True).alias("listed"))
    both = manifest.alias("m").join(listed.alias("l"), F.col("m.grp").eqNullSafe(F.col("l.grp")) & F.col("m.num").eqNullSafe(F.col("l.num")), "full_outer")
    missing = F.col("listed").isNull() | F.col("n_rows").isNull()
    # a row of the file is not held by it exactly if its record stands elsewhere too, or in it twice
    repeated = F.coalesce((F.col("n_repeated") > 0) | (F.col("n_held") < F.col("n_rows")), F.lit(False))
    miscounted = ~missing & ~F.coalesce(F.col("n_ids") == F.col("n_declared"), F.lit(False))
    out = both.select(F.coalesce("m.grp", "l.grp").alias("grp"), F.coalesce("m.num", "l.num").alias("num"), "n_rows", "n_held", "n_declared", repeated.alias("is_repeated"), miscounted.alias("is_miscounted"), missing.alias("is_missing"))
    return out.withColumn("as_is", ~(F.col("is_repeated") | F.col("is_miscounted") | F.col("is_missing")))
