"""Vectorised work on many short texts at once: shingles, circulant MinHash, exact Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Four bits a letter; letters beyond the nucleotide alphabet share the last code.
_LETTERS = b"ACGTNRYSWKMBDHV"
_CODE = np.full(256, 15, np.uint32)
_CODE[np.frombuffer(_LETTERS, np.uint8)] = np.arange(len(_LETTERS), dtype=np.uint32)
_DIM = np.uint32((1 << 24) - 1)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls are empty."""
    column = column.cast(pa.string()).fill_null("")
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every stretch, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def dna_shingles(offsets: np.ndarray, data: np.ndarray, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``width``-letter substrings of every text, sorted.

    Returns row offsets (n + 1) and codes (uint32); width is 8 at most.  A text
    shorter than ``width`` has none.
    """
    n = len(offsets) - 1
    code = _CODE[data]
    m = len(code) - width + 1
    if m <= 0:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint32)
    roll = np.zeros(m, np.uint32)
    for j in range(width):
        roll = (roll << np.uint32(4)) | code[j : j + m]
    lengths = np.maximum(np.diff(offsets) - width + 1, 0)
    at = ragged(offsets[:-1], lengths)
    keys = (np.repeat(np.arange(n, dtype=np.uint64), lengths) << np.uint64(32)) | roll[at].astype(np.uint64)
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32)), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of 0 .. 2^24 - 1: odd multipliers and shifted exclusive-ors are invertible."""
    x = (x * np.uint32(a)) & _DIM
    x ^= x >> np.uint32(13)
    x = (x * np.uint32(b)) & _DIM
    x ^= x >> np.uint32(11)
    return x


def circulant_minhash(offsets: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """``k`` signature coordinates for every row of shingle codes, uint32 [n, k].

    Two permutations make all coordinates: the first one scatters the elements,
    the second one is used again and again, circularly shifted by 1, 2, ... k
    places.  The elements are hashed into 2^24 places before.  A row without
    shingles gets the value 2^24 everywhere.
    """
    n = len(offsets) - 1
    out = np.full((n, k), 1 << 24, np.uint32)
    rows = np.flatnonzero(np.diff(offsets) > 0)
    if not len(rows):
        return out
    place = (codes * np.uint32(0x9E3779B1)) >> np.uint32(8)
    place = _permute(place, 0x2C1B3C6D, 0x297A2D39)
    starts = offsets[:-1][rows]
    for shift in range(1, k + 1):
        # the second permutation moved by `shift` places: element i gets the value of place i - shift
        out[rows, shift - 1] = np.minimum.reduceat(_permute((place - np.uint32(shift)) & _DIM, 0x85EBCA6B, 0xC2B2AE35), starts)
    return out


def intersection_sizes(offsets: np.ndarray, codes: np.ndarray, a: np.ndarray, b: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """Common elements of row ``a[i]`` and row ``b[i]``; rows hold sorted distinct codes."""
    out = np.zeros(len(a), np.int64)
    size = np.diff(offsets)
    need = np.maximum(size[a], size[b])
    order = np.argsort(need, kind="stable")
    at = 0
    while at < len(order):
        width = max(1, int(need[order[at]]))
        end = at
        # rows are in order of width, so the last one of a piece is the widest
        step = max(1, cells // (2 * width))
        end = min(len(order), at + step)
        while end > at + 1 and 2 * int(need[order[end - 1]]) * (end - at) > 2 * cells:
            end = at + max(1, (end - at) // 2)
        part = order[at:end]
        width = max(1, int(need[part[-1]]))
        both = np.empty((len(part), 2 * width), np.int64)
        for side, (rows, pad) in enumerate(((a[part], -1), (b[part], -1 - width))):
            block = both[:, side * width : (side + 1) * width]
            block[:] = pad - np.arange(width)  # fillers differ from all else
            length = size[rows]
            line = np.repeat(np.arange(len(part)), length)
            block[line, ragged(np.zeros(len(part), np.int64), length)] = codes[ragged(offsets[:-1][rows], length)]
        both.sort(axis=1)
        out[part] = (both[:, 1:] == both[:, :-1]).sum(axis=1)
        at = end
    return out


def run_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places with equal keys; ``keys`` must be sorted."""
    left, right = [], []
    active = np.flatnonzero(keys[1:] == keys[:-1]) if len(keys) > 1 else np.zeros(0, np.int64)
    step = 1
    while len(active):
        left.append(active)
        right.append(active + step)
        step += 1
        active = active[active + step < len(keys)]
        active = active[keys[active] == keys[active + step]]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least place that links (a, b) connect it with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label
