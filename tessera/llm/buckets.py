"""Work on buckets of bounded size: tiling of large ones and streaming over a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(df: DataFrame, bucket: str, row_id: str, size: int) -> DataFrame:
    """Replace ``bucket`` so that all pairs of rows of a bucket meet in a bucket of at most about ``2 * size`` rows.

    A bucket with up to ``size`` rows stays whole (``side`` 0).  A larger one
    is spread over blocks by a hash of the id; each block is a bucket (side 0),
    and so is each pair of blocks, whose rows carry side 1 and 2: there only
    rows of different sides are to be compared.
    """
    counts = df.groupBy(bucket).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("_tiles"))
    block = F.pmod(F.xxhash64(row_id), F.col("_tiles")).cast("int")
    rows = df.join(counts, bucket).withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    side = F.when(F.col("_block") == F.col("_other"), 0).when(F.col("_block") < F.col("_other"), 1).otherwise(2).cast("int")
    name = F.when(F.col("_tiles") == 1, F.xxhash64(bucket)).otherwise(F.xxhash64(bucket, F.least("_block", "_other"), F.greatest("_block", "_other")))
    return rows.withColumn("side", side).withColumn(bucket, name).drop("_tiles", "_block", "_other")


def whole_buckets(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables that hold whole buckets of a partition sorted by ``key``.

    No more than ``rows`` rows or ``size`` bytes are held besides the last bucket.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < rows and sum(x.nbytes for x in held) < size:
            continue
        table = pa.Table.from_batches(held)
        bucket = table.column(key).to_numpy()
        other = np.flatnonzero(bucket != bucket[-1])
        if len(other):
            cut = int(other[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of every stretch of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(values)]))


def fixed_binary(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of float32 vectors as a matrix [n, width]."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(len(column), width)


def to_binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a float32 matrix as a binary column."""
    matrix = np.ascontiguousarray(matrix, np.float32)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])


def vectors_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists with ``width`` elements and their values [n, width]; a null element is NaN."""
    import pyarrow.compute as pc

    length = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    at = np.flatnonzero(length == width)
    flat = column.take(pa.array(at)).flatten()
    values = np.array(pc.fill_null(pc.cast(flat, pa.float32()), np.nan), np.float32).reshape(len(at), width)
    return at, values
