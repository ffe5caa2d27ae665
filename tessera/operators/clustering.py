"""Hierarchical and density clustering of a selection of items.

The items (active guides, frequent outcomes) are at most some thousand, so their
pair table fits one task; the operators refuse more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of 4,000 items.
MOST_PAIRS = 8_000_000


def distance_matrix(pairs: pd.DataFrame, distance: str) -> tuple[list, np.ndarray]:
    """Labels in order and the symmetric matrix; a missing pair gets the largest distance."""
    labels = sorted(set(pairs["a"]) | set(pairs["b"]))
    place = {x: i for i, x in enumerate(labels)}
    out = np.full((len(labels), len(labels)), pairs[distance].max() if len(pairs) else 0.0)
    i, j = pairs["a"].map(place).to_numpy(int), pairs["b"].map(place).to_numpy(int)
    out[i, j] = out[j, i] = pairs[distance].to_numpy(float)
    np.fill_diagonal(out, 0.0)
    return labels, out


def spanning_tree(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of a minimum spanning tree in order of length, by Prim's method."""
    n = len(d)
    best, origin, inside = d[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0] = True
    out = []
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        out.append((float(best[j]), int(origin[j]), j))
        inside[j] = True
        closer = d[j] < best
        best, origin = np.where(closer, d[j], best), np.where(closer, j, origin)
    return sorted(out)


def single_linkage(d: np.ndarray) -> np.ndarray:
    """Merges as rows (left, right, distance, size); node n + i is made by merge i."""
    n = len(d)
    node, size = list(range(n)), {i: 1 for i in range(n)}
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, (length, a, b) in enumerate(spanning_tree(d)):
        ra, rb = find(a), find(b)
        x, y = sorted((node[ra], node[rb]))
        size[n + i] = size[x] + size[y]
        out.append((x, y, length, size[n + i]))
        parent[rb] = ra
        node[ra] = n + i
    return np.array(out).reshape(-1, 4)


def leaf_order(merges: np.ndarray, n: int, d: np.ndarray) -> list[int]:
    """Leaves from left to right; the halves of every merge are turned so that near ends meet."""
    order: dict[int, list[int]] = {i: [i] for i in range(n)}
    for i, (x, y, _, _) in enumerate(merges):
        a, b = order.pop(int(x)), order.pop(int(y))
        choices = [(d[p[-1], q[0]], k) for k, (p, q) in enumerate(((a, b), (a, b[::-1]), (a[::-1], b), (a[::-1], b[::-1])))]
        k = min(choices)[1]
        order[n + i] = (a if k < 2 else a[::-1]) + (b if k % 2 == 0 else b[::-1])
    return next(iter(order.values())) if order else []


def cut_tree(merges: np.ndarray, n: int, clusters: int) -> np.ndarray:
    """Labels of the items when the last merges are undone until there are ``clusters``."""
    parent = list(range(2 * n))
    for i, (x, y, _, _) in enumerate(merges[: max(0, n - clusters)]):
        parent[int(x)] = parent[int(y)] = n + i

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    roots = [top(i) for i in range(n)]
    names: dict[int, int] = {}
    return np.array([names.setdefault(r, len(names)) for r in roots])


def density_clusters(d: np.ndarray, min_size: int = 2, min_samples: int = 1, epsilon: float = 0.2) -> np.ndarray:
    """Labels by the hierarchy of mutual reachability and excess of mass; -1 is noise.

    Clusters that part below the distance ``epsilon`` stay together.
    """
    n = len(d)
    if n < 2:
        return np.full(n, -1)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    np.fill_diagonal(reach, 0.0)
    merges = single_linkage(reach)
    children = {n + i: (int(x), int(y)) for i, (x, y, _, _) in enumerate(merges)}
    height = {n + i: float(h) for i, (_, _, h, _) in enumerate(merges)}
    size = {**{i: 1 for i in range(n)}, **{n + i: int(s) for i, (_, _, _, s) in enumerate(merges)}}
    level = lambda h: 1.0 / max(h, 1e-12)
    birth, stable, below, members = {}, {}, {}, {}

    def leaves(x: int) -> list[int]:
        stack, out = [x], []
        while stack:
            y = stack.pop()
            stack += children.get(y, ())
            if y < n:
                out.append(y)
        return out

    root = 2 * n - 2
    todo = [(root, 0.0)]
    while todo:
        c, start = todo.pop()
        birth[c], stable[c], below[c], members[c] = start, 0.0, [], leaves(c)
        x = c
        while x >= n:
            a, b = children[x]
            lam = level(height[x])
            big = [y for y in (a, b) if size[y] >= min_size]
            if len(big) == 2:
                stable[c] += size[x] * (lam - start)
                below[c] = [a, b]
                todo += [(a, lam), (b, lam)]
                break
            lost = size[x] - sum(size[y] for y in big)
            stable[c] += lost * (lam - start)
            if not big:
                break
            x = big[0]
    chosen: set[int] = set()
    for c in sorted(birth):  # children before parents: a merge has a larger number than its parts
        if c == root:
            continue  # all items together are no cluster
        if below[c]:
            inner = sum(stable[k] for k in below[c])
            if stable[c] < inner:
                stable[c] = inner
                continue
            for k in members_below(below, c):
                chosen.discard(k)
        chosen.add(c)
    # clusters born below epsilon are replaced by their ancestor that is not
    up = {k: c for c, ks in below.items() for k in ks}
    final = set()
    for c in chosen:
        x = c
        while birth[x] > level(epsilon) and up.get(x, root) != root:
            x = up[x]
        final.add(x)
    final = {c for c in final if not any(p in final for p in _ancestors(up, c))}
    labels = np.full(n, -1)
    for k, c in enumerate(sorted(final, key=lambda c: min(members[c]))):
        labels[members[c]] = k
    return labels


def members_below(below: dict[int, list[int]], c: int) -> list[int]:
    out, stack = [], list(below[c])
    while stack:
        x = stack.pop()
        out.append(x)
        stack += below.get(x, [])
    return out


def _ancestors(up: dict[int, int], c: int) -> list[int]:
    out = []
    while c in up:
        c = up[c]
        out.append(c)
    return out


def _grouped(pairs: DataFrame, work, ddl: str) -> DataFrame:
    n = pairs.limit(MOST_PAIRS + 1).count()
    if n > MOST_PAIRS:
        raise ValueError("too many items for a clustering in one task; select fewer")
    return pairs.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(work, ddl)


def hierarchical(pairs: DataFrame, distance: str, clusters: int = 5) -> DataFrame:
    """``item, place, cluster_id``: single linkage, cut into at most ``clusters``, numbered along the leaves."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        labels, d = distance_matrix(rows, distance)
        merges = single_linkage(d)
        order = leaf_order(merges, len(labels), d)
        cut = cut_tree(merges, len(labels), clusters)
        seen: dict[int, int] = {}
        return pd.DataFrame([(labels[i], place, seen.setdefault(int(cut[i]), len(seen))) for place, i in enumerate(order)], columns=["item", "place", "cluster_id"])

    return _grouped(pairs.select("a", "b", distance), work, "item string, place int, cluster_id int")


def density(pairs: DataFrame, distance: str, min_size: int = 2, min_samples: int = 1, epsilon: float = 0.2) -> DataFrame:
    """``item, cluster_id`` by density; -1 is noise."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        labels, d = distance_matrix(rows, distance)
        return pd.DataFrame({"item": labels, "cluster_id": density_clusters(d, min_size, min_samples, epsilon)})

    return _grouped(pairs.select("a", "b", distance), work, "item string, cluster_id int")


def cluster_genes(assigned: DataFrame, genes: DataFrame) -> DataFrame:
    """Number of guides of every gene in every cluster."""
    return assigned.join(genes.select(F.col("guide").alias("item"), "gene"), "item").groupBy("cluster_id", "gene").agg(F.count("*").alias("n"))
