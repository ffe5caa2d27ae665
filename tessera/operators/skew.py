"""Per-key totals that do not pile up on heavy keys.

The rows are range-partitioned on the composite (key, record id, spread), with
boundaries from sampled quantiles, so a key with a third of all rows covers a
third of the partitions.  Every partition reduces its sorted run to partial
states: per key the totals of the records that lie strictly inside the
partition, and the first and the last record, which may go on in a neighbour.
The boundary records are stitched by (key, record id); everything after the
range exchange is as small as partitions plus keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

_STATE = "key string, kind string, rid string, n long, total decimal(38,0)"
_SCHEMA = pa.schema([("key", pa.string()), ("kind", pa.string()), ("rid", pa.string()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])


class _Run:
    """The state of the key that a sorted partition is in."""

    def __init__(self) -> None:
        self.started = False
        self.out: list[tuple] = []

    def _record(self, rid: str | None, value: int) -> None:
        """A finished record of the current key."""
        if not self.first_done:
            self.out.append((self.key, "edge", rid, 1, self.value))
            self.first_done = True
        else:
            self.n += 1
            self.total += value

    def feed(self, key: str | None, rid: str | None, value: int, n_inside: int, inside: int, last_rid: str | None, last_value: int) -> None:
        """A stretch of rows of one key in one batch.

        ``rid``/``value`` is its first record, ``last_rid``/``last_value`` its
        last one (the same one if there is one only), ``n_inside``/``inside``
        count the records between.
        """
        if not self.started or key != self.key:
            self.close()
            self.started, self.key, self.n, self.total, self.first_done = True, key, 0, 0, False
            self.rid, self.value = rid, value
        elif rid == self.rid:
            self.value = max(self.value, value)
        else:
            self._record(self.rid, self.value)
            self.rid, self.value = rid, value
        if last_rid != rid:
            self._record(self.rid, self.value)
            self.n += n_inside
            self.total += inside
            self.rid, self.value = last_rid, last_value

    def close(self) -> None:
        if not self.started:
            return
        self.out.append((self.key, "edge", self.rid, 1, self.value))
        if self.n:
            self.out.append((self.key, "inside", None, self.n, self.total))
        self.started = False

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)


def _differs(a: pa.Array) -> np.ndarray:
    """Where an element differs from the one before; a null equals a null."""
    code = np.asarray(pc.fill_null(a.dictionary_encode(null_encoding="encode").indices, -1))
    return np.concatenate([[True], code[1:] != code[:-1]])


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = _Run()
    for batch in batches:
        if not batch.num_rows:
            continue
        new_key = _differs(batch.column("key"))
        new_rec = new_key | _differs(batch.column("rid"))
        starts = np.flatnonzero(new_rec)
        value = np.asarray(batch.column("value"))
        best = np.maximum.reduceat(value, starts)
        sums = np.concatenate([[0], np.cumsum(best.astype(object))]) if np.abs(best).max(initial=0) > 2**40 else np.concatenate([[0], np.cumsum(best)])
        key_starts = np.flatnonzero(new_key[starts])  # places in starts
        key_ends = np.append(key_starts[1:], len(starts))
        keys, rids = batch.column("key"), batch.column("rid")
        for a, b in zip(key_starts.tolist(), key_ends.tolist()):
            inside = int(sums[b - 1] - sums[a + 1]) if b - a > 2 else 0
            run.feed(keys[int(starts[a])].as_py(), rids[int(starts[a])].as_py(), int(best[a]), max(0, b - a - 2), inside, rids[int(starts[b - 1])].as_py(), int(best[b - 1]))
        if len(run.out) > 10_000:
            yield run.take()
    run.close()
    yield run.take()


def totals_per_key(df: DataFrame, key: Column, record_id: Column, value: Column) -> DataFrame:
    """Distinct records and the sum of ``value`` per key, safe against heavy keys.

    Result: ``key string, n_records long, total decimal(38,0)``.  Rows with the
    same key and record id are one record, whose value is the largest one; a
    null value counts as 0.  A null key is a key of its own, and so is a null
    record id within its key.  An empty table gives no row.
    """
    rows = df.select(
        key.cast("string").alias("key"),
        record_id.cast("string").alias("rid"),
        F.coalesce(value.cast("long"), F.lit(0)).alias("value"),
        # copies of one record may be a third of all rows: they too are spread
        F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int").alias("spread"),
    )
    ranged = rows.repartitionByRange("key", "rid", "spread").sortWithinPartitions("key", "rid").select("key", "rid", "value")
    states = materialize(ranged.mapInArrow(_partial_states, _STATE), "key-states")
    edges = states.filter("kind = 'edge'").groupBy("key", "rid").agg(F.max("total").alias("total")).select("key", F.lit(1).cast("long").alias("n"), "total")
    inside = states.filter("kind = 'inside'").select("key", "n", "total")
    return edges.unionByName(inside).groupBy("key").agg(F.sum("n").alias("n_records"), F.sum("total").cast("decimal(38,0)").alias("total"))


def heavy_keys(totals: DataFrame, share: float = 0.05) -> DataFrame:
    """Adds the shares and whether a key is heavy: ``share`` of records or of the total.

    ``totals`` is a result of :func:`totals_per_key`.  The null key counts in
    the sums and is never heavy.  With nothing to share (sum 0) no key is heavy
    by that measure.
    """
    whole = totals.agg(F.sum("n_records"), F.sum("total").cast("decimal(38,0)")).first()
    records, total = int(whole[0] or 0), int(whole[1] or 0)
    part = lambda c, all_: F.col(c).cast("double") / F.lit(float(all_)) if all_ > 0 else F.lit(0.0)
    reaches = lambda c, all_: F.col(c).cast("double") >= F.lit(all_ * share) if all_ > 0 else F.lit(False)
    return totals.select(
        "key",
        "n_records",
        "total",
        part("n_records", records).alias("record_share"),
        part("total", total).alias("total_share"),
        (F.col("key").isNotNull() & (reaches("n_records", records) | reaches("total", total))).alias("is_heavy"),
    )
