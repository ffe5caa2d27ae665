"""A hierarchical navigable small-world graph in flat arrays, built and searched for many vectors at once.

Every layer is an int32 array [rows, degree] of neighbours, -1 where there are
fewer.  Vectors are unit length and similarity is their dot product.  Rows are
inserted in batches: a batch searches the graph so far, its members are also
compared with each other, links are chosen for diversity, and full neighbour
lists are pruned by the same rule.
"""

from __future__ import annotations

import numpy as np


def _top(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of every row, best first; -1 marks an empty place."""
    sim = np.where(ids >= 0, sim, -np.inf)
    if sim.shape[1] > 4 * k:
        part = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        sim, ids = np.take_along_axis(sim, part, 1), np.take_along_axis(ids, part, 1)
    order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    sim, ids = np.take_along_axis(sim, order, 1), np.take_along_axis(ids, order, 1)
    return sim, np.where(np.isfinite(sim), ids, -1)


class Graph:
    def __init__(self, vectors: np.ndarray, degree: int = 12, ef_build: int = 40, seed: int = 7) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        self.degree, self.ef_build = degree, ef_build
        level = np.minimum((-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(degree)).astype(np.int64), 6)
        self.layers: list[np.ndarray] = []  # from the base upwards: neighbours by row
        self.rows: list[np.ndarray] = []
        for l in range(int(level.max(initial=0)) + 1):
            self.rows.append(np.flatnonzero(level >= l))
            self.layers.append(np.full((n, degree * 2 if l == 0 else degree), -1, np.int32))
        for l in reversed(range(len(self.layers))):
            self._build(l)

    @classmethod
    def from_arrays(cls, vectors: np.ndarray, layers: list[np.ndarray], rows: list[np.ndarray]) -> Graph:
        """A stored graph, ready to be searched."""
        out = object.__new__(cls)
        out.x, out.layers, out.rows = vectors, layers, rows
        return out

    # -- building ---------------------------------------------------------

    def _build(self, l: int) -> None:
        rows, adj = self.rows[l], self.layers[l]
        first = rows[: min(64, len(rows))]
        done = len(first)
        sim = self.x[first] @ self.x[first].T
        np.fill_diagonal(sim, -np.inf)
        ids = np.broadcast_to(first, sim.shape)
        self._link(adj, first, *_top(sim, np.where(np.isfinite(sim), ids, -1), min(self.ef_build, len(first))))
        while done < len(rows):
            batch = rows[done : done + min(1024, done)]
            sim, ids = self._search_layer(l, self.x[batch], self._entries(self.x[batch], l, rows[:done]), self.ef_build)
            own = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(own, -np.inf)
            near_sim, near = _top(own, np.where(np.isfinite(own), np.broadcast_to(batch, own.shape), -1), min(self.ef_build, len(batch)))
            self._link(adj, batch, *_top(np.concatenate([sim, near_sim], 1), np.concatenate([ids, near], 1), self.ef_build))
            done += len(batch)

    def _entries(self, q: np.ndarray, l: int, inserted: np.ndarray) -> np.ndarray:
        """Places from which the search of layer ``l`` starts."""
        fixed = np.broadcast_to(inserted[: min(4, len(inserted))], (len(q), min(4, len(inserted))))
        if l + 1 >= len(self.layers):
            return fixed
        above = self._descend(q, l + 1)
        # the layer above may hold rows that this one has not inserted yet
        known = np.zeros(len(self.x), bool)
        known[inserted] = True
        above = np.where((above >= 0) & known[np.maximum(above, 0)], above, -1)
        return np.concatenate([above, fixed], 1)

    def _descend(self, q: np.ndarray, stop: int, width: int = 4) -> np.ndarray:
        top = len(self.layers) - 1
        entry = np.broadcast_to(self.rows[top][: min(4, len(self.rows[top]))], (len(q), min(4, len(self.rows[top]))))
        for l in range(top, stop - 1, -1):
            _, entry = self._search_layer(l, q, entry, width)
        return entry

    def _diverse(self, sim: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Of candidates, best first, those that are nearer to their row than to any candidate chosen before; then the best of the rest."""
        n, c = ids.shape
        out, count = np.full((n, k), -1, np.int32), np.zeros(n, np.int64)
        blocked = ids < 0
        vec = self.x[np.maximum(ids, 0)]
        closest = np.full((n, c), -np.inf, np.float32)
        for j in range(c):
            ok = ~blocked[:, j] & (closest[:, j] < sim[:, j]) & (count < k)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            out[at, count[at]] = ids[at, j]
            count[at] += 1
            blocked[at, j] = True
            if j + 1 < c:
                closest[at, j + 1 :] = np.maximum(closest[at, j + 1 :], np.einsum("nd,ncd->nc", vec[at, j], vec[at, j + 1 :]))
        for j in range(c):
            at = np.flatnonzero(~blocked[:, j] & (count < k))
            out[at, count[at]] = ids[at, j]
            count[at] += 1
        return out

    def _link(self, adj: np.ndarray, rows: np.ndarray, sim: np.ndarray, ids: np.ndarray) -> None:
        chosen = self._diverse(sim, ids, self.degree)
        adj[rows, : self.degree] = chosen
        # the other direction
        src, dst = np.repeat(rows, self.degree), chosen.reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        while len(dst):
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            begin = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
            place = np.arange(len(dst)) - np.repeat(begin, np.diff(np.append(begin, len(dst))))
            now = place < 16  # the rest in the next round
            target = dst[begin]
            incoming = np.full((len(target), 16), -1, np.int64)
            incoming[np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(dst))))[now], place[now]] = src[now]
            have = adj[target].astype(np.int64)
            incoming = np.where((incoming[:, :, None] == have[:, None, :]).any(2), -1, incoming)
            both = np.concatenate([have, incoming], 1)
            fits = (both >= 0).sum(1) <= adj.shape[1]
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
            adj[target[fits]] = packed[fits, : adj.shape[1]]
            full = np.flatnonzero(~fits)
            if len(full):
                cand = both[full]
                s = np.einsum("nd,ncd->nc", self.x[target[full]], self.x[np.maximum(cand, 0)])
                adj[target[full]] = self._diverse(*_top(s, cand, cand.shape[1]), adj.shape[1])
            src, dst = src[~now], dst[~now]

    # -- searching --------------------------------------------------------

    def _search_layer(self, l: int, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search with a beam of ``ef`` for all queries in step."""
        adj, n = self.layers[l], len(q)
        seen = np.zeros((n, len(self.x)), bool)
        line = np.arange(n)[:, None]
        entry = np.where(entry >= 0, entry, -1).astype(np.int64)
        # an entry that is named twice counts once
        entry = np.sort(entry, 1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
        seen[line, np.maximum(entry, 0)] |= entry >= 0
        sim = np.einsum("nd,ncd->nc", q, self.x[np.maximum(entry, 0)])
        pad = max(0, ef - entry.shape[1])
        sim, ids = _top(np.pad(sim, ((0, 0), (0, pad)), constant_values=-np.inf), np.pad(entry, ((0, 0), (0, pad)), constant_values=-1), ef)
        fresh = ids >= 0
        active = np.arange(n)
        while len(active):
            open_ = fresh[active]
            active = active[open_.any(1)]
            if not len(active):
                break
            best = fresh[active].argmax(1)
            node = ids[active, best]
            fresh[active, best] = False
            nb = adj[node].astype(np.int64)
            new = (nb >= 0) & ~seen[active[:, None], np.maximum(nb, 0)]
            seen[active[:, None], np.maximum(nb, 0)] |= nb >= 0
            some = np.flatnonzero(new.any(1))
            if not len(some):
                continue
            act, nb, new = active[some], nb[some], new[some]
            s = np.where(new, np.einsum("nd,ncd->nc", q[act], self.x[np.maximum(nb, 0)]), -np.inf)
            both_sim, both_ids = np.concatenate([sim[act], s], 1), np.concatenate([ids[act], np.where(new, nb, -1)], 1)
            both_fresh = np.concatenate([fresh[act], new], 1)
            order = np.argsort(-both_sim, axis=1, kind="stable")[:, :ef]
            sim[act], ids[act], fresh[act] = (np.take_along_axis(v, order, 1) for v in (both_sim, both_ids, both_fresh))
        return sim, np.where(np.isfinite(sim), ids, -1)

    def search(self, q: np.ndarray, k: int, ef: int = 32, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and rows of the ``k`` best matches of every query, best first, -1 for none."""
        sims, ids = [], []
        for at in range(0, len(q), batch):
            part = np.ascontiguousarray(q[at : at + batch], np.float32)
            entry = self._entries(part, 0, self.rows[0])
            s, i = self._search_layer(0, part, entry, max(ef, k))
            sims.append(s[:, :k])
            ids.append(i[:, :k])
        return np.concatenate(sims), np.concatenate(ids)
