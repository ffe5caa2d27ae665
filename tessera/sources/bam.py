"""Alignment files in the BAM format: a reader on any file system, and sorted, routed files written by tasks.

Files are read whole through the binary file source, so that a shared store is
enough; records of one file are decoded in one task.  A route (a category, a
guide) is spread over as many sorted files as its rows ask for.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the format
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 65280

RECORD = "name string, flag int, ref string, pos int, mapq int, cigar string, seq string, qual string"
_SCHEMA = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("ref", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
_CODE = np.full(256, 15, np.uint8)
_CODE[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(16)
_CODE[np.frombuffer(BASES.lower().encode(), np.uint8)] = np.arange(16)
_LETTER = np.frombuffer(BASES.encode(), np.uint8)
UNMAPPED = 4


def _inflate(data: bytes) -> bytes:
    """The bytes of all gzip members, one after the other."""
    out = []
    while data:
        unpack = zlib.decompressobj(31)
        out.append(unpack.decompress(data))
        if not unpack.eof:
            raise ValueError("a block of the file is cut off")
        data = unpack.unused_data
    return b"".join(out)


def decode(data: bytes) -> Iterator[tuple]:
    """The records of a BAM file; positions from 0, -1 and a null reference for none."""
    raw = _inflate(data)
    if raw[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", raw, 4)[0]
    refs, at = struct.unpack_from("<i", raw, at)[0], at + 4
    names = []
    for _ in range(refs):
        size = struct.unpack_from("<i", raw, at)[0]
        names.append(raw[at + 4 : at + 3 + size].decode())
        at += 8 + size
    while at < len(raw):
        size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiiBBHHHi", raw, at)
        p = at + 36
        name, p = raw[p : p + l_name - 1].decode(), p + l_name
        ops = struct.unpack_from(f"<{n_cigar}I", raw, p)
        p += 4 * n_cigar
        packed = np.frombuffer(raw, np.uint8, (l_seq + 1) // 2, p)
        p += (l_seq + 1) // 2
        seq = _LETTER[np.stack([packed >> 4, packed & 15], 1).reshape(-1)[:l_seq]].tobytes().decode()
        scores = np.frombuffer(raw, np.uint8, l_seq, p)
        qual = None if l_seq and scores[0] == 255 else (scores + 33).tobytes().decode()
        yield name, flag, names[ref] if ref >= 0 else None, pos, mapq, "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops), seq, qual
        at += 4 + size


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            held: list[tuple] = []
            for record in decode(content.as_py()):
                held.append(record)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """``name, flag, ref, pos, mapq, cigar, seq, qual`` of all BAM files below ``path``; tags are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bam").load(path)
    return files.select("content").mapInArrow(_decoded, RECORD)


class _Writer:
    """A BAM file in blocks of at most ``BLOCK`` bytes; complete under its name only after ``close``."""

    def __init__(self, path: str, references: list[tuple[str, int]]) -> None:
        self.path, self.number = path, {name: i for i, (name, _) in enumerate(references)}
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.file = open(path + ".part", "wb")
        text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{l}\n" for n, l in references)
        self.held = bytearray(b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(references)))
        for name, length in references:
            self.held += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)

    def _block(self, data: bytes) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(data) + pack.flush()
        self.file.write(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data)))

    def add(self, name: str, flag: int | None, ref: str | None, pos: int | None, mapq: int | None, cigar: str | None, seq: str | None, qual: str | None) -> None:
        seq, label = seq or "", (name or "*").encode() + b"\0"
        code = _CODE[np.frombuffer(seq.encode(), np.uint8)]
        code = np.append(code, np.zeros(len(code) % 2, np.uint8)).reshape(-1, 2)
        ops = [(int(n) << 4) | OPERATIONS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")]
        scores = b"\xff" * len(seq) if qual is None else (np.frombuffer(qual.encode(), np.uint8) - 33).tobytes()
        if len(scores) != len(seq) or len(label) > 255:
            raise ValueError(f"quality or name does not fit the record {name!r}")
        body = struct.pack("<iiBBHHHiiii", self.number.get(ref, -1), -1 if pos is None else pos, len(label), mapq or 0, 4680, len(ops), UNMAPPED if flag is None else flag, len(seq), -1, -1, 0)
        body += label + struct.pack(f"<{len(ops)}I", *ops) + (code[:, 0] << 4 | code[:, 1]).astype(np.uint8).tobytes() + scores
        self.held += struct.pack("<i", len(body)) + body
        while len(self.held) >= BLOCK:
            self._block(bytes(self.held[:BLOCK]))
            del self.held[:BLOCK]

    def close(self) -> None:
        if self.held:
            self._block(bytes(self.held))
        self.file.write(END_OF_FILE)
        self.file.close()
        os.replace(self.path + ".part", self.path)


def _write(folder: str, keys: list[str], references: list[tuple[str, int]], most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, route, writer, n, files = TaskContext.get().partitionId(), None, None, 0, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, *(f.name for f in _SCHEMA))]
            for row in zip(*columns):
                if row[: len(keys)] != route or n >= most:
                    if writer:
                        writer.close()
                        files[-1][1] = n
                    route, n = row[: len(keys)], 0
                    where = "/".join(f"{k}={quote('' if v is None else str(v), safe='')}" for k, v in zip(keys, route))
                    path = os.path.join(folder, where, f"part-{part:05d}-{len(files):05d}.bam")
                    writer = _Writer(path, references)
                    files.append([path, 0])
                writer.add(*row[len(keys) :])
                n += 1
        if writer:
            writer.close()
            files[-1][1] = n
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], names=["path", "n"])

    return work


def write_bam(df: DataFrame, folder: str, keys: list[str], order: list[str], references: list[tuple[str, int]] = (), records_per_file: int = 1_000_000) -> DataFrame:
    """Write records, sorted by ``keys`` and ``order``, into one folder per key value; returns ``path, n`` of every file.

    The folder must be one that all executors write to.  Rows are ranged over
    tasks by key and order, so a key with most rows has several files, whose
    ranges follow each other.  Columns that a record lacks are written as
    unmapped; a task that runs again writes the same files.
    """
    have = {c: F.col(c) for c in df.columns}
    rows = df.select(*[F.col(k) for k in keys], *[have.get(f.name, F.lit(None)).cast("int" if pa.types.is_int32(f.type) else "string").alias(f.name) for f in _SCHEMA], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    ordered = [*keys, *[f"_o{i}" for i in range(len(order))]]
    tasks = max(1, -(-df.count() // records_per_file))
    ranged = rows.repartitionByRange(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *ordered).sortWithinPartitions(*ordered).drop(*ordered[len(keys) :])
    written = ranged.mapInArrow(_write(folder.removeprefix("file://"), keys, list(references), records_per_file), "path string, n long")
    return df.sparkSession.createDataFrame(written.collect(), "path string, n long")


def by_name(alignments: DataFrame) -> DataFrame:
    """``name, seq, qual, alignments``: all alignments of a read, which are few, in order of position; seq and qual of the first that has them."""
    one = F.struct("ref", "pos", "flag", "mapq", "cigar")
    whole = F.when(F.length("seq") > 0, F.struct("flag", "seq", "qual"))
    return alignments.groupBy("name").agg(F.min(whole).alias("_s"), F.sort_array(F.collect_list(one)).alias("alignments")).select("name", "_s.seq", "_s.qual", "alignments")


def merged(parts: list[tuple[str, DataFrame]], sep: str = "_") -> DataFrame:
    """Records of several files in one table, each name with the label of its part."""
    out = None
    for label, part in parts:
        rows = part.withColumn("name", F.concat("name", F.lit(sep + label)))
        out = rows if out is None else out.unionByName(rows)
    return out


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that an alignment covers."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1)
    return F.aggregate(runs, F.lit(0), lambda n, x: n + x.cast("int"))
