"""Geometry of the alignments of one read that columns cannot express, applied in Arrow batches.

Positions count from 0 and ends are inclusive.  The functions work on small
lists of plain records; :func:`resolve_reads` runs them over the reads that are
left after the column features have decided the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Piece:
    """An alignment without gaps of its own, or one with the indels it holds."""

    ref: str
    q_start: int
    q_end: int
    r_start: int
    r_end: int
    strand: str = "+"
    edits: int = 0
    indels: tuple[tuple[str, int, int], ...] = ()

    @property
    def length(self) -> int:
        return self.q_end - self.q_start + 1


def split_at_indels(a: Piece, least: int = 1) -> list[Piece]:
    """Parts of a forward alignment between its indels of at least ``least`` bases.

    Indels are (kind, reference place, length): a deletion removes the bases
    from that place on, an insertion stands before it.
    """
    out, q, r = [], a.q_start, a.r_start
    for kind, place, length in sorted(a.indels, key=lambda i: i[1]):
        if length < least:
            continue
        stop = place - 1
        out.append(replace(a, q_start=q, q_end=q + (stop - r), r_start=r, r_end=stop, indels=()))
        q = out[-1].q_end + 1 + (length if kind == "I" else 0)
        r = place + (length if kind == "D" else 0)
    out.append(replace(a, q_start=q, q_end=a.q_end, r_start=r, r_end=a.r_end, indels=()))
    return [p for p in out if p.length > 0]


def parsimonious(pieces: list[Piece]) -> list[Piece]:
    """The pieces that are needed to cover what all of them cover: longest first, those that add nothing are dropped."""
    kept: list[Piece] = []
    covered: set[int] = set()
    for p in sorted(pieces, key=lambda p: (-p.length, p.q_start, p.r_start)):
        own = set(range(p.q_start, p.q_end + 1))
        if own - covered:
            kept.append(p)
            covered |= own
    needed = []
    for p in kept:
        rest = set().union(*[range(k.q_start, k.q_end + 1) for k in kept if k is not p])
        if set(range(p.q_start, p.q_end + 1)) - rest:
            needed.append(p)
    return sorted(needed, key=lambda p: p.q_start)


def merge_adjacent(pieces: list[Piece], most_gap: int = 0) -> list[Piece]:
    """Neighbours on one diagonal become one piece."""
    out: list[Piece] = []
    for p in sorted(pieces, key=lambda p: p.q_start):
        last = out[-1] if out else None
        if last and last.ref == p.ref and last.strand == p.strand and p.q_start - last.q_end - 1 <= most_gap and p.q_start - last.q_start == p.r_start - last.r_start:
            out[-1] = replace(last, q_end=max(last.q_end, p.q_end), r_end=max(last.r_end, p.r_end), edits=last.edits + p.edits)
        else:
            out.append(p)
    return out


def local_alignment(query: str, target: str, match: int = 5, mismatch: int = -8, indel: int = -60) -> tuple[int, int, int, int, int]:
    """Best local alignment: score, query start and end, target start and end; all -1 with score 0 if nothing matches.

    With gaps this dear the best path is a diagonal in practice; gaps are still
    tried.
    """
    rows, cols = len(query) + 1, len(target) + 1
    score = [[0] * cols for _ in range(rows)]
    start = [[(i, j) for j in range(cols)] for i in range(rows)]
    best = (0, -1, -1, -1, -1)
    for i in range(1, rows):
        for j in range(1, cols):
            value, origin = 0, (i, j)
            for s, o in (
                (score[i - 1][j - 1] + (match if query[i - 1] == target[j - 1] else mismatch), start[i - 1][j - 1]),
                (score[i - 1][j] + indel, start[i - 1][j]),
                (score[i][j - 1] + indel, start[i][j - 1]),
            ):
                if s > value:
                    value, origin = s, o
            score[i][j], start[i][j] = value, origin
            if value > best[0]:
                best = (value, origin[0], i - 1, origin[1], j - 1)
    return best


def edge_seed(read: str, target: str, left: bool, longest: int = 20, shortest: int = 4, low: int = 0, high: int | None = None) -> Piece | None:
    """The longest perfect match of an end of the read to the target, tried from ``longest`` down to ``shortest`` letters and then extended."""
    high = len(target) if high is None else high
    for k in range(min(longest, len(read)), shortest - 1, -1):
        seed = read[:k] if left else read[-k:]
        at = target.find(seed, low, high) if left else target.rfind(seed, low, high)
        if at < 0:
            continue
        if left:
            while k < len(read) and at + k < len(target) and read[k] == target[at + k]:
                k += 1
            return Piece("target", 0, k - 1, at, at + k - 1)
        end, first = at + k - 1, len(read) - k
        while first > 0 and at > 0 and read[first - 1] == target[at - 1]:
            first, at = first - 1, at - 1
        return Piece("target", first, len(read) - 1, at, end)
    return None


def insertion_with_deletion(left: Piece, right: Piece, read: str) -> dict | None:
    """What lies between the two edge pieces: removed reference bases and inserted read bases; None if they do not follow each other.

    Where the pieces overlap in the read, the right one gives way.
    """
    overlap = max(0, left.q_end - right.q_start + 1)
    q, r = right.q_start + overlap, right.r_start + overlap
    if r <= left.r_end:
        return None
    return {"start": left.r_end + 1, "removed": r - left.r_end - 1, "inserted": read[left.q_end + 1 : q], "shared": overlap}


def junction_homology(left: Piece, right: Piece, target: str) -> int:
    """Bases at the junction that fit on either side: the microhomology of a deletion."""
    n = 0
    while right.r_start - n - 1 > left.r_end and left.r_end - n >= left.r_start and target[left.r_end - n] == target[right.r_start - n - 1]:
        n += 1
    m = 0
    while left.r_end + 1 + m < right.r_start and right.r_start + m <= right.r_end and target[left.r_end + 1 + m] == target[right.r_start + m]:
        m += 1
    return n + m


def templated_by_target(gap: str, left: Piece, right: Piece, target: str, cut: int, reach: int = 50, homology: int = 1) -> dict | None:
    """An insertion that copies the target near the cut with homology on both sides: synthesis-dependent joining.

    Returns the kind (loop-out for the same strand, snap-back for the other
    one) and where the template lies; None without one.
    """
    if not gap:
        return None
    before, after = target[max(0, left.r_end - homology + 1) : left.r_end + 1], target[right.r_start : right.r_start + homology]
    wanted = before + gap + after
    low, high = max(0, cut - reach), min(len(target), cut + reach)
    window = target[low:high]
    flip = wanted[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for kind, text in (("loop-out", wanted), ("snap-back", flip)):
        at = window.find(text)
        while at >= 0:
            start, stop = low + at, low + at + len(text) - 1
            if stop <= cut or start > cut:
                return {"kind": kind, "start": start, "stop": stop}
            at = window.find(text, at + 1)
    return None


def donor_side(donor: Piece, target_edge: Piece | None, arms: tuple[tuple[int, int], ...], left: bool) -> str:
    """How one end of a donor insertion meets the target.

    intended: inside a homology arm that both share; blunt: the donor ends at
    the junction without an arm; unintended: it runs past its arm; ambiguous
    without a target edge.
    """
    if target_edge is None:
        return "ambiguous"
    end = donor.r_start if left else donor.r_end
    for low, high in arms:
        if low <= end <= high:
            touch = target_edge.q_end - donor.q_start + 1 if left else donor.q_end - target_edge.q_start + 1
            return "intended" if touch >= 0 else "unintended"
    gap = donor.q_start - target_edge.q_end - 1 if left else target_edge.q_start - donor.q_end - 1
    return "blunt" if abs(gap) <= 2 else "unintended"


def foreign_kind(piece: Piece, left: Piece | None, right: Piece | None, read_length: int, primers: tuple[tuple[int, int], ...], near: int = 10, most_gap: int = 5) -> str:
    """A foreign stretch as nonspecific amplification, transversion or genomic insertion."""
    past = [e.r_end - p[1] if side == "l" else p[0] - e.r_start for e, p, side in ((left, primers[0], "l"), (right, primers[-1], "r")) if e is not None]
    gaps = [piece.q_start - left.q_end - 1 if left else piece.q_start, right.q_start - piece.q_end - 1 if right else read_length - 1 - piece.q_end]
    if piece.q_start == 0:
        return "transversion"
    if all(x < near for x in past) and all(g < most_gap for g in gaps):
        return "nonspecific amplification"
    return "genomic insertion"


def align_read(read: str, target: str, cut: int, most_edits: float = 0.1) -> list[dict]:
    """Alignments of a read to the target, as :mod:`tessera.operators.categorise` takes them.

    A read of the target's length with few mismatches is one alignment.  Else
    the perfect matches of both ends are joined to one alignment with what lies
    between them as a deletion, an insertion, or both; ends that do not follow
    each other stay apart, neighbours on one diagonal are merged, and what
    covers no base of its own is dropped.
    """
    n = len(read)
    row = lambda p, edits=0, indels=(): {"ref": p.ref, "q_start": p.q_start, "q_end": p.q_end, "r_start": p.r_start, "r_end": p.r_end, "strand": p.strand, "edits": edits, "indels": [{"kind": k, "start": a, "length": b} for k, a, b in indels]}
    if n == len(target):
        edits = sum(a != b for a, b in zip(read, target))
        if edits <= most_edits * n:
            return [row(Piece("target", 0, n - 1, 0, n - 1), edits)]
    left, right = edge_seed(read, target, True, high=cut + 1), edge_seed(read, target, False, low=cut + 1)
    gap = insertion_with_deletion(left, right, read) if left and right else None
    if gap is None:
        return [row(p) for p in merge_adjacent(parsimonious([p for p in (left, right) if p]))]
    indels = [(kind, gap["start"], size) for kind, size in (("D", gap["removed"]), ("I", len(gap["inserted"]))) if size]
    return [row(Piece("target", 0, n - 1, left.r_start, right.r_end), 0, indels)]


def align_reads(reads: DataFrame, target: str, cut: int, seq: str = "seq") -> DataFrame:
    """Adds ``alignments`` to reads; equal sequences of a batch are aligned once, null sequences have none."""
    from tessera.operators.categorise import ALIGNMENT

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema.fields) + f", alignments array<{ALIGNMENT}>"
    kind = pa.list_(pa.struct([("ref", pa.string()), ("q_start", pa.int32()), ("q_end", pa.int32()), ("r_start", pa.int32()), ("r_end", pa.int32()), ("strand", pa.string()), ("edits", pa.int32()), ("indels", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())])))]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, list[dict]] = {}
            out = []
            for text in batch.column(seq).to_pylist():
                if text is not None and text not in known:
                    known[text] = align_read(text, target, cut)
                out.append(known.get(text, []))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "alignments"])

    return reads.mapInArrow(work, ddl)


_DDL = "read_id string, left_end int, right_start int, removed int, inserted string, shared int, homology int, templated string, template_start int"


def resolve_reads(reads: DataFrame, target: str, cut: int, read_id: str = "read_id", seq: str = "seq") -> DataFrame:
    """Junctions of reads against ``target`` from perfect edge seeds: one row per read with both edges.

    Reads without one of the edges, or whose edges do not follow each other,
    give no row; null sequences neither.  The work per read is bounded by the
    length of read and target.
    """
    rows = reads.select(reads[read_id].cast("string").alias("read_id"), reads[seq].alias("seq")).filter("seq is not null")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _DDL.split(", ")]
        for part in parts:
            # equal sequences are resolved once
            known: dict[str, tuple | None] = {}
            out = []
            for rid, text in zip(part["read_id"], part["seq"]):
                if text not in known:
                    left, right = edge_seed(text, target, True, high=cut + 1), edge_seed(text, target, False, low=cut + 1)
                    gap = insertion_with_deletion(left, right, text) if left and right else None
                    if gap is None:
                        known[text] = None
                    else:
                        found = templated_by_target(gap["inserted"], left, right, target, cut)
                        known[text] = (left.r_end, right.r_start, gap["removed"], gap["inserted"], gap["shared"], junction_homology(left, right, target), found and found["kind"], found and found["start"])
                if known[text] is not None:
                    out.append((rid, *known[text]))
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(work, _DDL)
