"""Passages of held-out items in a corpus.

Words are maximal runs of ASCII letters and digits in lower case.  A passage is
any stretch of ``PASSAGE`` words of an item; a document leaks an item if it has
a stretch within ``ERRORS`` word edits of a passage.  A passage is split into
``ERRORS + 1`` pieces; with at most that many edits one piece is untouched, so
all documents are searched for exact pieces, by rolling hashes of words, and
every hit is verified with Myers' bit-parallel edit distance over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 12
ERRORS = 1
#: Items up to this many bytes of text are sent to all executors; beyond it pieces are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class _Hashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all stretches of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out * _FACTOR) ^ (out >> np.uint64(29)) ^ hashes[j : j + n]
    return out


def myers(pattern: list[bytes], text: list[bytes]) -> int:
    """Least edit distance of ``pattern`` and any stretch of ``text``, by bit-parallel columns."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = vn | (full & ~(d0 | vp)), vp & d0
        if hp & last:
            score += 1
        if hn & last:
            score -= 1
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
        best = min(best, score)
    return best


def leak_distance(item: list[bytes], text: list[bytes], hits: list[tuple[int, int]], passage: int, errors: int, piece: int) -> int | None:
    """Least word edits between a passage of ``item`` and ``text`` near ``hits`` (place in text, place in item); None above ``errors``."""
    best, seen = errors + 1, set()
    for p, q in hits:
        for part in range(errors + 1):
            start = q - part * piece
            if start < 0 or start + passage > len(item) or (start, p - q) in seen:
                continue
            seen.add((start, p - q))
            low = max(0, p - part * piece - errors)
            best = min(best, myers(item[start : start + passage], text[low : p - part * piece + passage + errors]))
            if best == 0:
                return 0
    return best if best <= errors else None


@dataclass
class _Index:
    """The pieces of all items: sorted hashes, and for each the item and its place."""

    ids: list[int]
    words: list[list[bytes]]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray


def _index(items: list[tuple[int, str]], passage: int, piece: int) -> _Index:
    cache = _Hashes()
    kept = [(i, words_of(t)) for i, t in items]
    kept = [(i, w) for i, w in kept if i is not None and len(w) >= passage]
    grams = [rolling(np.fromiter((cache[w] for w in ws), np.uint64, len(ws)), piece) for _, ws in kept]
    flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
    order = np.argsort(flat, kind="stable")
    return _Index([i for i, _ in kept], [w for _, w in kept], flat[order], item[order].astype(np.int64), place[order].astype(np.int64))


def _search(index: _Index, passage: int, errors: int, piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                if len(words) < passage - errors or not len(index.hashes):
                    continue
                grams = rolling(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), piece)
                low = np.searchsorted(index.hashes, grams, "left")
                found = np.flatnonzero(index.hashes[np.minimum(low, len(index.hashes) - 1)] == grams)
                if not len(found):
                    continue
                high = np.searchsorted(index.hashes, grams[found], "right")
                hits: dict[int, list[tuple[int, int]]] = {}
                for p, a, b in zip(found.tolist(), low[found].tolist(), high.tolist()):
                    for k in range(a, b):
                        hits.setdefault(int(index.item[k]), []).append((p, int(index.place[k])))
                for k, places in hits.items():
                    distance = leak_distance(index.words[k], words, places, passage, errors, piece)
                    if distance is not None:
                        out.append((index.ids[k], doc, distance))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32())], names=["item_id", "doc_id", "edits"])

    return work


def _grams(piece: int, keep_place: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            ids, grams = [], []
            for row, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                g = np.unique(rolling(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), piece))
                grams.append(g.astype(np.int64))
                ids.append(np.full(len(g), row, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*grams, np.zeros(0, np.int64)]))], names=["id", "gram"])

    return work


def _verify_pairs(passage: int, errors: int, piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                index = _index([(r["item_id"], r["item_text"])], passage, piece)
                one = pa.RecordBatch.from_arrays([pa.array([r["doc_id"]], pa.int64()), pa.array([r["text"]], pa.string())], names=["doc_id", "text"])
                for found in _search(index, passage, errors, piece)(iter([one])):
                    out.append(found)
            yield from out

    return work


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", passage: int = PASSAGE, errors: int = ERRORS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``item_id, doc_id, edits`` for every document that holds a passage of an item.

    ``edits`` is the least number of word edits, 0 for a passage that stands in
    the document word for word.  Items with fewer than ``passage`` words, null
    texts and null ids give no row.  Repeated rows of an id count once.
    """
    piece = passage // (errors + 1)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    small = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).filter("item_id is not null and item_text is not null")
    size = small.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    ddl = "item_id long, doc_id long, edits int"
    if size <= broadcast_bytes:
        index = _index([(r[0], r[1]) for r in small.collect()], passage, piece)
        found = docs.mapInArrow(_search(index, passage, errors, piece), ddl)
    else:
        left = docs.withColumnRenamed("doc_id", "id").mapInArrow(_grams(piece, False), "id long, gram long").withColumnRenamed("id", "doc_id")
        right = small.select(F.col("item_id").alias("id"), F.col("item_text").alias("text")).mapInArrow(_grams(piece, False), "id long, gram long").withColumnRenamed("id", "item_id")
        pairs = left.join(right, "gram").select("doc_id", "item_id").distinct()
        found = pairs.join(small, "item_id").join(docs, "doc_id").select("item_id", "item_text", "doc_id", "text").mapInArrow(_verify_pairs(passage, errors, piece), ddl)
    return found.groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"))
