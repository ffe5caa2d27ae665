"""The most similar vectors of every vector, by graphs over shards.

Vectors are spread over shards by their nearest centre of a small k-means model
(an index fitted on at most ``SAMPLE_ROWS`` vectors; every vector is placed).
Each shard, one task, builds a hierarchical navigable small-world graph, which
is stored as flat neighbour arrays in one row of a table.  A vector is searched
in the shards of all centres that are nearly as similar to it as its best one.
How nearly is measured: the exact neighbours of ``SAMPLE_QUERIES`` vectors among
all vectors are looked up, and the margin is the smallest one by which the share
``ROUTED`` of them lies in a searched shard, so that more centres at more rows
cost no recall.  The searches of a shard are spread over tasks, each of which
reads the stored graph, and the shard results are merged.  A centre with too
many vectors is spread over several shards, all of which are searched.  Exact
copies of a vector are one node of the graph and are put back afterwards.
:func:`exact_neighbours` compares a set of vectors with all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.buckets import fixed_binary, stretches, to_binary, vectors_of
from tessera.llm.hnsw import Graph
from tessera.session import materialize

SAMPLE_ROWS = 20_000
SHARD_ROWS = 12_000
#: Searches of one shard in one task.
QUERY_ROWS = 12_000
#: Vectors whose exact neighbours set the margin, and the share of these that must lie in a searched shard.
SAMPLE_QUERIES, ROUTED = 512, 0.97
#: Centres that are searched in any case.
LEAST_PROBES = 4
MAX_CENTRES = 8192
#: Partitions of one exchange; beyond it a task takes several shards in turn.
MOST_PARTITIONS = 20_000
BEAM = 32
SALTS = 32


def _unit(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = vectors_of(batch.column("vec"), width)
            x = np.where(np.isfinite(x), x, 0).astype(np.float64)
            length = np.sqrt((x**2).sum(1))
            ok = length > 0
            unit = (x[ok] / length[ok][:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at[ok])), to_binary(unit)], names=["id", "vec"])

    return work


def unit_vectors(df: DataFrame, row_id: str, vector: str, width: int) -> DataFrame:
    """``id, vec``: one row per id whose list has ``width`` places that are not all 0, at length 1."""
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") == width))
    return rows.mapInArrow(_unit(width), "id long, vec binary").groupBy("id").agg(F.min("vec").alias("vec"))


def _centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        label = np.concatenate([(x[a : a + 4096] @ centre.T).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, label, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(length > 0, total / np.where(length > 0, length, 1), centre).astype(np.float32)
    return centre


def _probe(centre: np.ndarray, width: int, margin: float, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the list ``near`` of the centres within ``margin`` of the best one, the best one first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sim = fixed_binary(part.column("vec"), width) @ centre.T
                order = np.argsort(-sim, axis=1, kind="stable").astype(np.int32)
                sim = np.take_along_axis(sim, order, 1)
                chosen = sim >= sim[:, :1] - margin
                chosen[:, :least] = True
                offsets = np.concatenate([[0], np.cumsum(chosen.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.ListArray.from_arrays(offsets, pa.array(order[chosen]))], names=["id", "vec", "near"])

    return work


def _best_of_part(queries: np.ndarray, ids: np.ndarray, width: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` most similar rows of a partition for every query, with their vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        best, other, vec = np.full((n, k), -2.0, np.float32), np.full((n, k), -1, np.int64), np.zeros((n, k, width), np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, own = fixed_binary(part.column("vec"), width), part.column("id").to_numpy()
                sim = queries @ x.T
                sim[ids[:, None] == own[None, :]] = -2.0
                top = np.argpartition(-sim, min(k, sim.shape[1]) - 1, axis=1)[:, :k]
                both = np.concatenate([best, np.take_along_axis(sim, top, 1)], 1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(both, order, 1)
                other = np.take_along_axis(np.concatenate([other, own[top]], 1), order, 1)
                vec = np.take_along_axis(np.concatenate([vec, x[top]], 1), order[:, :, None], 1)
        line, place = np.nonzero(best > -2.0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[line]), pa.array(other[line, place]), pa.array(best[line, place].astype(np.float64)), to_binary(vec[line, place])], names=["id", "other", "cosine", "vec"])

    return work


def exact_neighbours(vectors: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """``id, other, cosine, vec``: the ``k`` most similar rows of ``vectors`` for a stated set of at most some thousand queries.

    Every task compares its rows with all queries in blocks and keeps the best;
    both tables are ``id, vec`` with vectors of length 1.
    """
    some = queries.toPandas()
    x = np.frombuffer(b"".join(some["vec"]), np.float32).reshape(-1, width)
    parts = vectors.mapInArrow(_best_of_part(x, some["id"].to_numpy(np.int64), width, k), "id long, other long, cosine double, vec binary")
    return parts.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).filter(F.col("_r") <= k).drop("_r")


def fit_routing(nodes: DataFrame, centre: np.ndarray, width: int, k: int, queries: int = SAMPLE_QUERIES, routed: float = ROUTED) -> float:
    """The margin of similarity to a centre by which the share ``routed`` of exact neighbours lies in a searched shard."""
    asked = nodes.select("id", "vec").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(queries)
    found = exact_neighbours(nodes.select("id", "vec"), asked, width, k).join(asked.select("id", F.col("vec").alias("query")), "id").select("query", "vec").toPandas()
    if not len(found):
        return 0.0
    q, x = (np.frombuffer(b"".join(found[c]), np.float32).reshape(-1, width) @ centre.T for c in ("query", "vec"))
    need = np.sort(q.max(1) - q[np.arange(len(q)), x.argmax(1)])
    return float(need[int(routed * (len(need) - 1))]) + 1e-6


_GRAPH = pa.schema([("shard", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("layers", pa.list_(pa.binary())), ("rows", pa.list_(pa.binary()))])
_GRAPH_DDL = "shard int, ids binary, vecs binary, layers array<binary>, rows array<binary>"


def _build_graphs(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row of flat arrays for every shard; rows come by shard."""

    def graph_row(shard: int, ids: list[np.ndarray], vecs: list[np.ndarray]) -> pa.RecordBatch:
        graph = Graph(np.concatenate(vecs))
        row = {"shard": shard, "ids": np.concatenate(ids).astype(np.int64).tobytes(), "vecs": graph.x.tobytes(), "layers": [x.tobytes() for x in graph.layers], "rows": [x.astype(np.int32).tobytes() for x in graph.rows]}
        return pa.RecordBatch.from_pylist([row], schema=_GRAPH)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vecs = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("shard").to_numpy()
            for a, b in stretches(key):
                if key[a] != shard:
                    if ids:
                        yield graph_row(int(shard), ids, vecs)
                    shard, ids, vecs = key[a], [], []
                ids.append(batch.column("id").to_numpy()[a:b])
                vecs.append(fixed_binary(batch.column("vec").slice(a, b - a), width))
        if ids:
            yield graph_row(int(shard), ids, vecs)

    return work


def _search_graphs(width: int, k: int, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by part of a shard, the stored graph of the shard (``ids`` not null) before its queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, known = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            part, stored = batch.column("part").to_numpy(), np.asarray(batch.column("ids").is_valid()).astype(np.int64)
            for a, b in stretches(part.astype(np.int64) * 2 + stored):
                if stored[a]:
                    row = batch.slice(a, 1).to_pylist()[0]
                    known = np.frombuffer(row["ids"], np.int64)
                    graph = Graph.from_arrays(np.frombuffer(row["vecs"], np.float32).reshape(-1, width), [np.frombuffer(x, np.int32).reshape(len(known), -1) for x in row["layers"]], [np.frombuffer(x, np.int32) for x in row["rows"]])
                    continue
                rows, x = batch.column("id").slice(a, b - a).to_numpy(), fixed_binary(batch.column("vec").slice(a, b - a), width)
                _, found = graph.search(x, k + 1, beam)
                line, place = np.nonzero(found >= 0)
                hit = found[line, place]
                other = known[hit] != rows[line]
                line, hit = line[other], hit[other]
                cosine = np.einsum("nd,nd->n", x[line].astype(np.float64), graph.x[hit].astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(rows[line]), pa.array(known[hit]), pa.array(cosine)], names=["id", "other", "cosine"])

    return work


def _first(df: DataFrame, key: str, k: int, *order) -> DataFrame:
    """The first ``k`` rows of every key, ranked within salted parts before."""
    part = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(SALTS))
    rows = df.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy(key, "_p").orderBy(*order))).filter(F.col("_r") <= k)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= k).drop("_p", "_r")


def _shards(placed: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """``cell, base, shards``: the numbers of the shards of every centre, and how many there are.

    A centre above twice the usual size has several shards.  There is one row
    per centre, so at most ``MAX_CENTRES``.
    """
    sizes = placed.groupBy(F.col("near")[0].alias("cell")).count().orderBy("cell").toPandas()
    shards = np.maximum(1, -(-sizes["count"].to_numpy() // (2 * shard_rows)))
    rows = list(zip(sizes["cell"].tolist(), (np.cumsum(shards) - shards).tolist(), shards.tolist()))
    return placed.sparkSession.createDataFrame(rows, "cell int, base int, shards int"), int(shards.sum())


def search_shards(placed: DataFrame, width: int, k: int, shard_rows: int, beam: int) -> DataFrame:
    """``id, other, cosine`` from every searched shard, up to ``k + 1`` a shard; ``placed`` is a written table ``id, vec, near``."""
    cells, n_shards = _shards(placed, shard_rows)
    home = placed.select("id", "vec", F.col("near")[0].alias("cell")).join(cells, "cell")
    index = home.select((F.col("base") + F.pmod(F.xxhash64("id"), F.col("shards"))).cast("int").alias("shard"), "id", "vec")
    graphs = materialize(index.repartitionById(min(n_shards, MOST_PARTITIONS), F.col("shard")).sortWithinPartitions("shard").mapInArrow(_build_graphs(width), _GRAPH_DDL), "graphs")
    asked = placed.select("id", "vec", F.explode("near").alias("cell")).join(cells, "cell")
    asked = asked.select("id", "vec", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("shards") - 1)).alias("shard"))
    # one row per shard: how many tasks share its searches
    load = asked.groupBy("shard").count().orderBy("shard").toPandas()
    tasks = np.maximum(1, -(-load["count"].to_numpy() // QUERY_ROWS))
    spread = placed.sparkSession.createDataFrame(list(zip(load["shard"].tolist(), (np.cumsum(tasks) - tasks).tolist(), tasks.tolist())), "shard int, first int, tasks int")
    none = F.lit(None)
    queries = asked.join(spread, "shard").select((F.col("first") + F.pmod(F.xxhash64("id", F.lit(2)), F.col("tasks"))).cast("int").alias("part"), "id", "vec", none.cast("binary").alias("ids"), none.cast("binary").alias("vecs"), none.cast("array<binary>").alias("layers"), none.cast("array<binary>").alias("rows"))
    stored = graphs.join(spread, "shard").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("tasks") - 1)).alias("part"), none.cast("long").alias("id"), none.cast("binary").alias("vec"), "ids", "vecs", "layers", "rows")
    both = stored.unionByName(queries).repartitionById(min(int(tasks.sum()), MOST_PARTITIONS), F.col("part")).sortWithinPartitions("part", F.col("ids").isNull())
    return both.mapInArrow(_search_graphs(width, k, beam), "id long, other long, cosine double")


def nearest_vectors(df: DataFrame, row_id: str, vector: str, width: int, k: int = 5, shard_rows: int = SHARD_ROWS, margin: float | None = None, least: int = LEAST_PROBES, beam: int = BEAM) -> DataFrame:
    """``id, other, cosine``: the ``k`` vectors most similar to every vector by cosine, ties by the smaller id.

    Null lists, lists of another length, all-zero lists and null ids have no
    neighbours and are none; a null or non-finite element counts as 0.  Repeated
    rows of an id count once.  The search is approximate; measured recall is in
    the README.
    """
    vectors = materialize(unit_vectors(df, row_id, vector, width), "unit")
    nodes = materialize(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "nodes")
    n = nodes.count()
    if not n:
        return vectors.select("id", F.col("id").alias("other"), F.lit(0.0).alias("cosine")).limit(0)
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vec").toPandas()["vec"]
    x = np.frombuffer(b"".join(sample), np.float32).reshape(-1, width)
    centre = _centres(x, max(1, min(MAX_CENTRES, -(-n // shard_rows))))
    # with few centres all are searched anyway
    margin = 0.0 if margin is None and len(centre) <= least else fit_routing(nodes, centre, width, k) if margin is None else margin
    placed = materialize(nodes.select("id", "vec").mapInArrow(_probe(centre, width, margin, least), "id long, vec binary, near array<int>"), "placed")
    found = search_shards(placed, width, k, shard_rows, beam)
    near = found.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).filter(F.col("_r") <= k).drop("_r")
    copies = nodes.filter("n > 1")
    if not copies.limit(1).count():
        return near
    near = materialize(near, "near")
    member = vectors.join(nodes.select("vec", F.col("id").alias("node")), "vec").select("id", "node")
    # of a group of copies only the k + 1 smallest ids can be anybody's neighbour
    some = _first(member, "node", k + 1, "id")
    links = near.unionByName(nodes.select("id", F.col("id").alias("other"), F.lit(1.0).alias("cosine")).join(copies.select("id"), "id", "left_semi"))
    # neighbours of a node with its copies are the same for all members: at most k + 1 are kept before they are given to the members
    offered = links.join(some.select(F.col("node").alias("other"), F.col("id").alias("copy")), "other").select(F.col("id").alias("node"), F.col("copy").alias("other"), "cosine")
    best = offered.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "other"))).filter(F.col("_r") <= k + 1).drop("_r")
    given = member.join(best, "node").filter("id <> other").select("id", "other", "cosine")
    return given.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).filter(F.col("_r") <= k).drop("_r")
