"""The most frequent items of a column in bounded memory.

Every partition keeps a heavy part and a light part.  The heavy part is a hash
table of buckets, each with one item, its votes, and the votes of the other
items that came by; when these exceed ``EVICT`` times the votes of the
resident, it is evicted into the light part, a compact array of counters, and
the newcomer takes its bucket.  Two tables with independent hashes make it
unlikely that two heavy items keep each other out.  Partitions are merged by
recombining equal buckets and adding equal counters.  For every resident the
sketch gives a lower bound (its votes) and an upper bound (votes and counter).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
COUNTERS = 16384
TABLES = 2
EVICT = 8
#: Rows that are counted exactly before they go into the sketch.
BATCH_ROWS = 200_000

_SKETCH = pa.schema([("field", pa.string()), ("kind", pa.string()), ("tab", pa.int32()), ("slot", pa.int32()), ("item", pa.int64()), ("votes", pa.int64()), ("flag", pa.bool_())])
_DDL = "field string, kind string, tab int, slot int, item long, votes long, flag boolean"


def _slots(items: np.ndarray, salt: int, size: int) -> np.ndarray:
    x = items.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def counter_slot(items: np.ndarray) -> np.ndarray:
    return _slots(items, 101, COUNTERS)


class HeavyLight:
    """The sketch of one field in one partition: ``TABLES`` heavy tables, each with its light counters."""

    def __init__(self) -> None:
        self.item = np.zeros((TABLES, BUCKETS), np.int64)
        self.votes = np.zeros((TABLES, BUCKETS), np.int64)
        self.against = np.zeros((TABLES, BUCKETS), np.int64)
        self.flag = np.zeros((TABLES, BUCKETS), bool)
        self.light = np.zeros((TABLES, COUNTERS), np.int64)

    def add(self, items: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct items with their counts."""
        for t in range(TABLES):
            self._add(t, items, counts)

    def _add(self, t: int, items: np.ndarray, counts: np.ndarray) -> None:
        slot = _slots(items, t + 1, BUCKETS)
        # of the items of one bucket only the most frequent one may claim it
        order = np.lexsort((items, -counts, slot))
        items, counts, slot = items[order], counts[order], slot[order]
        home = (self.votes[t, slot] > 0) & (self.item[t, slot] == items)
        np.add.at(self.votes[t], slot[home], counts[home])
        items, counts, slot = items[~home], counts[~home], slot[~home]
        if not len(items):
            return
        lead = np.concatenate([[True], slot[1:] != slot[:-1]])
        vacant = self.votes[t, slot] == 0
        # every other vote is cast against the resident
        np.add.at(self.against[t], slot[~vacant], counts[~vacant])
        evict = lead & ~vacant & (self.against[t, slot] >= EVICT * self.votes[t, slot])
        out = slot[evict]
        np.add.at(self.light[t], counter_slot(self.item[t, out]), self.votes[t, out])
        take = lead & (vacant | evict)
        at = slot[take]
        self.flag[t, at] = evict[take]  # votes of a newcomer may already be in the counters
        self.item[t, at], self.votes[t, at], self.against[t, at] = items[take], counts[take], 0
        rest = ~take
        np.add.at(self.light[t], counter_slot(items[rest]), counts[rest])
        # what follows in a bucket that was just filled counts against the new resident
        late = rest & (vacant | np.isin(slot, at))
        np.add.at(self.against[t], slot[late & vacant], counts[late & vacant])

    def rows(self, field: str) -> pa.RecordBatch:
        t, s = np.nonzero(self.votes)
        lt, ls = np.nonzero(self.light)
        n, m = len(t), len(lt)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([field] * (n + m), pa.string()),
                pa.array(["heavy"] * n + ["light"] * m, pa.string()),
                pa.array(np.concatenate([t, lt]).astype(np.int32)),
                pa.array(np.concatenate([s, ls]).astype(np.int32)),
                pa.array(np.concatenate([self.item[t, s], np.zeros(m, np.int64)])),
                pa.array(np.concatenate([self.votes[t, s], self.light[lt, ls]])),
                pa.array(np.concatenate([self.flag[t, s], np.zeros(m, bool)])),
            ],
            schema=_SKETCH,
        )


def _sketch(fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = {f: HeavyLight() for f in fields}
        held: dict[str, list[np.ndarray]] = {f: [] for f in fields}
        seen, waiting = 0, 0

        def feed() -> None:
            for f in fields:
                if held[f]:
                    sketches[f].add(*np.unique(np.concatenate(held[f]), return_counts=True))
                    held[f].clear()

        for batch in batches:
            seen += batch.num_rows
            waiting += batch.num_rows
            for f in fields:
                held[f].append(batch.column(f).drop_null().to_numpy(zero_copy_only=False))
            if waiting >= BATCH_ROWS:
                feed()
                waiting = 0
        feed()
        for f in fields:
            yield sketches[f].rows(f)
        yield pa.RecordBatch.from_arrays([pa.array(["*"]), pa.array(["total"]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([0]), pa.array([seen]), pa.array([False])], schema=_SKETCH)

    return work


def _with_counter_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counter_slot(batch.column("item").to_numpy()).astype(np.int32))], names=[*batch.schema.names, "counter"])


def sketch_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The merged sketches: one row per (field, table, item) that is resident in some partition.

    ``rows`` has one row per record with an item hash (long) per field; a null
    is no item but its record counts.  Result: ``field, tab, item, lower,
    upper, total``: bounds of the count of the item and the number of records.
    """
    parts = rows.select(*fields).mapInArrow(_sketch(fields), _DDL)
    # equal buckets hold few different items after the partitions are joined; equal items are added up
    merged = parts.groupBy("field", "kind", "tab", "slot", "item").agg(F.sum("votes").alias("votes"), F.max("flag").alias("flag"), F.count("*").alias("holders"))
    return merged


def bounds(merged: DataFrame) -> DataFrame:
    """Lower and upper bounds of every resident item of a written sketch."""
    light = merged.filter("kind = 'light'").select("field", "tab", F.col("slot").alias("counter"), F.col("votes").alias("spilled"))
    heavy = merged.filter("kind = 'heavy'").select("field", "tab", "item", "votes")
    slots = heavy.mapInArrow(_with_counter_slot, "field string, tab int, item long, votes long, counter int")
    one = slots.join(light, ["field", "tab", "counter"], "left").select("field", "tab", "item", "votes", (F.col("votes") + F.coalesce("spilled", F.lit(0))).alias("upper"))
    # both tables hold true bounds, so the tighter ones are true as well
    return one.groupBy("field", "item").agg(F.max("votes").alias("lower"), F.min("upper").alias("upper"))


def frequent_items(records: DataFrame, record_id: str, items: dict[str, object], share: float, materialize) -> tuple[DataFrame, DataFrame, int]:
    """Candidates for items that ``share`` of all distinct records hold, with bounds of their counts.

    ``items`` maps a field to the column of its value.  Returns the candidates
    (``field, item_hash, lower, upper``), the deduplicated records (``rid`` and a
    hash per field) and the number of distinct records.  Every item with at
    least that share is a candidate unless it was evicted in every partition
    and table at the end of its input.  Rows that repeat an id are one record.
    A null id is one record.  An empty table gives no candidate.
    """
    fields = list(items)
    hashed = records.select(F.col(record_id).alias("rid"), *[F.when(c.isNotNull(), F.xxhash64(c)).alias(f) for f, c in items.items()])
    # longs only, so that the aggregate stays in generated code and sums up before the shuffle
    distinct = materialize(hashed.groupBy("rid").agg(*[F.max(f).alias(f) for f in fields]), "records")
    merged = materialize(sketch_counts(distinct, fields), "sketch")
    total = merged.filter("kind = 'total'").agg(F.sum("votes")).first()[0] or 0
    found = bounds(merged.filter("kind <> 'total'")).filter(F.col("upper") >= F.lit(total * share)).withColumnRenamed("item", "item_hash")
    return materialize(found, "candidates"), distinct, int(total)


def exact_counts(candidates: DataFrame, distinct: DataFrame, records: DataFrame, items: dict[str, object]) -> DataFrame:
    """``field, item, n_records, lower, upper``: the candidates with their exact counts and values."""
    fields = list(items)
    keys = candidates.select("field", "item_hash")
    # the candidates are at most (1 + error) / share per field, far below any broadcast limit; the planner decides by their size
    unpivot = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("item_hash")) for f in fields])).alias("x")
    counts = distinct.select(unpivot).select("x.*").join(keys, ["field", "item_hash"]).groupBy("field", "item_hash").agg(F.count("*").alias("n_records"))
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(c.isNotNull(), F.xxhash64(c)).alias("item_hash"), c.alias("item")) for f, c in items.items()])).alias("x")
    values = records.select(pair).select("x.*").join(keys, ["field", "item_hash"]).groupBy("field", "item_hash").agg(F.min("item").alias("item"))
    return candidates.join(counts, ["field", "item_hash"]).join(values, ["field", "item_hash"]).select("field", "item", "n_records", "lower", "upper")
