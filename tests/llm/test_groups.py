"""Similarity clusters, nearest vectors, near-duplicate reads and their survivors, against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import buckets, clusters, hnsw, mixture, near_duplicates, neighbours, shingles, survivors
from tessera.operators.components import connected_components


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# -- kernels --------------------------------------------------------------------


def shingle_sets(texts, width=8):
    return [{t[i : i + width] for i in range(len(t) - width + 1)} for t in texts]


def random_texts(n, seed=1, letters="ACGTN"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 8, 9, 60, 200]))) for _ in range(n // 2)]
    return base + ["".join(c if rng.random() > 0.05 else rng.choice(letters) for c in rng.choice(base)) for _ in range(n - n // 2)]


def test_shingles_and_exact_intersection():
    import pyarrow as pa

    texts = random_texts(60) + ["ACGTACGTRYKM" * 300]
    offsets, codes = shingles.dna_shingles(*shingles.string_bytes(pa.array(texts)))
    sets = shingle_sets(texts)
    assert [int(x) for x in np.diff(offsets)] == [len(s) for s in sets]
    a, b = np.triu_indices(len(texts), 1)
    got = shingles.intersection_sizes(offsets, codes, a, b, cells=5000)
    assert [int(x) for x in got] == [len(sets[i] & sets[j]) for i, j in zip(a, b)]


def test_minhash_estimates_similarity():
    import pyarrow as pa

    rng = random.Random(5)
    t = "".join(rng.choice("ACGT") for _ in range(2000))
    u = t[:1500] + "".join(rng.choice("ACGT") for _ in range(500))
    offsets, codes = shingles.dna_shingles(*shingles.string_bytes(pa.array([t, u, ""])))
    sig = shingles.circulant_minhash(offsets, codes, 400)
    s, v, _ = shingle_sets([t, u, ""])
    assert abs((sig[0] == sig[1]).mean() - len(s & v) / len(s | v)) < 0.08
    assert (sig[2] == 1 << 24).all()


def test_run_pairs_and_labels():
    a, b = shingles.run_pairs(np.array([1, 1, 1, 2, 3, 3]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert shingles.least_labels(6, np.array([5, 4, 1]), np.array([4, 3, 2])).tolist() == [0, 1, 1, 3, 3, 3]


# -- near duplicates --------------------------------------------------------------

READS = "read_id long, quartet_name string, umi string, seq string, qual string, sequenced_at timestamp, bucket int, rid string"


def make_reads(n_molecules=40, seed=3, hot=0):
    rng = random.Random(seed)
    dna = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    bend = lambda s, k: "".join(c if i not in set(rng.sample(range(len(s)), k)) else rng.choice("ACGTN") for i, c in enumerate(s))
    out, templates = [], [dna(110) for _ in range(6)]
    for m in range(n_molecules):
        q, u, t = rng.choice(["Q1", " q1", "Q2"]), dna(12), bend(rng.choice(templates), 8)
        for _ in range(rng.randint(1, 6)):
            s = bend(t, rng.randint(0, 6))
            if rng.random() < 0.2:
                s = s[:40] + dna(rng.randint(1, 8)) + s[40:]
            out.append((q, bend(u, rng.choice([0, 0, 1])), s if rng.random() < 0.9 else s.lower()))
    for _ in range(hot):
        out.append(("Q1", "GGGGGGGGGGGG", bend(templates[0], 5)))
        out.append(("Q1", "GGGGGGGGGGGG", templates[1]))
    rows = [(i + 1, *r, None if i % 11 == 0 else "".join(chr(33 + rng.randint(2, 40)) for _ in r[2]), None if i % 7 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 5)), 1, "x") for i, r in enumerate(out)]
    n = len(rows)
    rows += [(n + 1, "Q1", None, dna(100), "I", None, 1, "x"), (n + 2, "Q1", dna(12), None, "I", None, 1, "x"), (n + 3, "Q1", "A" * 12, "", "", None, 1, "x"), (n + 4, "Q1", "A" * 12, "", "", None, 1, "x"), (n + 5, None, "A" * 12, "ACGTACGTAC", "", None, 1, "x"), (n + 6, None, "A" * 12, "ACGTACGTAC", "", None, 1, "x"), (None, "Q1", "A" * 12, "ACGTACGTAC", "", None, 1, "x")]
    return rows + rows[:10]


def brute_groups(rows):
    seen = {r[0]: r for r in rows if r[0] is not None and r[2] and r[3]}
    ids = sorted(seen)
    fold = {i: ((seen[i][1] or "\0").strip().upper(), seen[i][2].upper(), s) for i, s in zip(ids, shingle_sets([seen[i][3].upper() for i in ids]))}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            (q, u, s), (r, v, t) = fold[i], fold[j]
            if q == r and len(u) == len(v) and sum(a != b for a, b in zip(u, v)) <= 1 and s and t and 2 * len(s & t) >= len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {k: v for k, v in groups.items() if len(v) > 1}


@pytest.mark.parametrize("bucket_rows,hot", [(1024, 0), (2, 0), (6, 40)])
def test_molecule_groups(spark, bucket_rows, hot):
    rows = make_reads(hot=hot)
    df = spark.createDataFrame(rows, READS)
    groups = near_duplicates.molecule_groups(df, bucket_rows=bucket_rows)
    want = brute_groups(rows)
    assert pairs(groups) == sorted((i, k) for k, v in want.items() for i in v)
    found = pairs(near_duplicates.group_pairs(groups))
    assert found == sorted((a, b) for v in want.values() for x, a in enumerate(v) for b in v[x + 1 :])


def test_no_reads(spark):
    assert near_duplicates.molecule_groups(spark.createDataFrame([], READS)).count() == 0


def test_survivors(spark):
    rows = make_reads(seed=9)
    df = spark.createDataFrame(rows, READS)
    groups = near_duplicates.molecule_groups(df)
    got = pairs(survivors.surviving_reads(df, groups, salts=3))
    seen = {r[0]: r for r in rows if r[0] is not None}
    low = dt.datetime(1900, 1, 1)
    want = []
    for k, v in brute_groups(rows).items():
        late = lambda i: -((seen[i][5] or low) - low).total_seconds()
        s = min(v, key=lambda i: (-sum(c in "ACGT" for c in seen[i][3].upper()), -(sum(ord(c) - 33 for c in seen[i][4]) if seen[i][4] is not None else -1), late(i), i))
        u = min(v, key=lambda i: (seen[i][2].upper().count("N"), late(i), i))
        want.append((k, s, u))
    assert got == sorted(want)


def test_survivors_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, 1, None) for i in (5, 3, 4)] + [(9, None, 1)], "id long, g long, v long")
    got = {r.g: r.id for r in survivors.best_rows(df, "g", [F.col("v").desc_nulls_last()], "id", salts=2).collect()}
    assert got == {1: 3, None: 9}


# -- clusters -----------------------------------------------------------------------


def profiles(n_groups=25, width=16, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_groups):
        centre = rng.normal(size=width)
        for _ in range(rng.integers(1, 8)):
            x = (centre + rng.normal(scale=0.15, size=width)) * rng.uniform(0.3, 3) + rng.normal()
            out.append([None if rng.random() < 0.05 else float(np.float32(v)) for v in x])
    rows = [(i + 1, v, "clash", 1) for i, v in enumerate(out)]
    n = len(rows)
    rows += [(n + 1, None, "", 1), (n + 2, [1.0] * width, "", 1), (n + 3, [1.0] * (width - 1), "", 1), (n + 4, [None] * width, "", 1), (n + 5, [None] * (width - 1) + [2.0], "", 1), (None, out[0], "", 1), (n + 6, out[0], "", 1), (n + 7, [], "", 1)]
    return rows + rows[:5]


def brute_profiles(rows, width, threshold=0.8):
    seen = {r[0]: np.array([np.nan if x is None else x for x in r[1]], np.float32).astype(float) for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == width}
    ids = sorted(i for i, x in seen.items() if len(set(x[~np.isnan(x)])) > 1)
    out = []
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = ~np.isnan(seen[i]) & ~np.isnan(seen[j])
            x, y = seen[i][both], seen[j][both]
            if len(x) > 1 and x.std() > 0 and y.std() > 0 and np.corrcoef(x, y)[0, 1] >= threshold:
                out.append((i, j))
    return out


@pytest.mark.parametrize("cell_rows,tile_rows,split_rows", [(500, 2048, 2048), (8, 5, 2048), (8, 2048, 12)])
def test_similar_pairs(spark, cell_rows, tile_rows, split_rows):
    rows = profiles()
    df = spark.createDataFrame(rows, "id long, v array<float>, bucket string, cell int")
    found, vectors, model = clusters.similar_pairs(df, "id", "v", 16, cell_rows=cell_rows, tile_rows=tile_rows, split_rows=split_rows)
    want = brute_profiles(rows, 16)
    got = pairs(found)
    assert len(got) == len(set(got)) and set(got) <= set(want)
    assert len(got) >= (1.0 if cell_rows == 500 else 0.9) * len(want)


def test_typical_members(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    near = [[float(x) for x in centre + rng.normal(scale=s, size=16)] for s in (0.001, 0.2, 0.25, 0.3)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(near)], "id long, v array<double>")
    found, vectors, model = clusters.similar_pairs(df, "id", "v", 16)
    out = clusters.typical_members(clusters.clusters_of_groups(found, vectors, model, 16), vectors, model, 16, top=2).collect()
    assert len(out) == 1 and out[0]["size"] == 4 and out[0].cluster_id == 0 and len(out[0].typical) == 2 and out[0].typical[0] == 0


def test_chained_groups_are_parted_by_the_criterion(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=16), rng.normal(size=16)
    ends = [(i, [float(x) for x in (a if i < 100 else b) + rng.normal(scale=0.02, size=16)]) for i in range(200)]
    # a chain of mixed profiles links both ends
    bridge = [(200 + i, [float(x) for x in a * (1 - t) + b * t]) for i, t in enumerate(np.linspace(0.1, 0.9, 17))]
    df = spark.createDataFrame(ends + bridge, "id long, v array<double>")
    found, vectors, model = clusters.similar_pairs(df, "id", "v", 16)
    assert connected_components(found, "a", "b").select("component").distinct().count() == 1
    got = dict(pairs(clusters.clusters_of_groups(found, vectors, model, 16, sample=150, salt_rows=60)))
    # the ends are parted, and each has few components
    first, second = {got[i] for i in range(100)}, {got[i] for i in range(100, 200)}
    assert len(got) == 217 and not first & second and len(first) <= 3 and len(second) <= 3


def test_bound_misses_no_similar_pair():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(40, 16)), 5, 0) + rng.normal(scale=0.5, size=(200, 16))
    x[rng.random(x.shape) < 0.25] = np.nan
    rows = clusters._Rows(x)
    i, j = np.meshgrid(np.arange(100), np.arange(100, 200), indexing="ij")
    r = clusters.exact_correlations(rows, i.ravel(), j.ravel()).reshape(100, 100)
    for k, l in zip(*np.nonzero(r > 0.5)):
        both = ~np.isnan(x[k]) & ~np.isnan(x[l + 100])
        assert r[k, l] == pytest.approx(np.corrcoef(x[k, both], x[l + 100, both])[0, 1])
    least = clusters.least_products(rows, 0, 100, 100, 200, 0.8)
    assert ((rows.fast[:100] @ rows.fast[100:].T >= least) | ~(r >= 0.8)).all() and (r >= 0.8).any()


def test_large_cells_are_split(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(300, 16)))]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    vectors = clusters.clean_vectors(df, "id", "v", 16)
    model = clusters.fit_cells(vectors, 16, 300, cell_rows=150)
    placed = vectors.mapInArrow(clusters._place(model, 16, 4.0), clusters._PLACED)
    parts = clusters.split_cells(placed, 16, model.axes, 4.0, split_rows=40, most=8)
    homes = parts.filter("home").groupBy("cell").count().collect()
    # every record has one home, and no home is large
    assert sum(r[1] for r in homes) == 300 and max(r[1] for r in homes) <= 80
    assert parts.filter("home").select("id").distinct().count() == 300


def test_no_profiles(spark):
    found, _, model = clusters.similar_pairs(spark.createDataFrame([(1, None)], "id long, v array<float>"), "id", "v", 16)
    assert found.count() == 0 and model is None


def test_mixture_finds_components():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.2, (150, 3)) for m in (-4, 0, 4)])
    model, scores = mixture.choose(x, [1, 3, 8], rounds=40)
    assert min(scores, key=scores.get) in (3, 8) and scores[3] < scores[1]
    assert model.weight.sum() == pytest.approx(1)
    # the log density is that of the formula
    one = mixture.Mixture(np.array([1.0]), np.array([[1.0, 2.0]]), np.array([[0.5, 2.0]]))
    want = sum(-0.5 * math.log(2 * math.pi * v) - (a - m) ** 2 / (2 * v) for a, m, v in zip((0.3, 4.0), (1, 2), (0.5, 2)))
    assert one.log_density(np.array([[0.3, 4.0]]))[0, 0] == pytest.approx(want, abs=1e-5)


def test_tiles_meet_every_pair_once(spark):
    df = spark.range(23).select(F.lit(7).alias("bucket"), F.col("id"))
    rows = buckets.tiled(df, "bucket", "id", 5).collect()
    seen = {}
    by = {}
    for r in rows:
        by.setdefault(r.bucket, []).append((r.id, r.side))
    for v in by.values():
        for i, s in v:
            for j, t in v:
                if i < j and (s == 0 or s != t):
                    seen[i, j] = seen.get((i, j), 0) + 1
    assert set(seen.values()) == {1} and len(seen) == 23 * 22 // 2


# -- nearest vectors -------------------------------------------------------------------


def vectors(n=400, width=24, seed=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 8, width))
    return (centre[rng.integers(0, len(centre), n)] + rng.normal(scale=0.35, size=(n, width))).astype(np.float32)


def test_graph_recall_and_degenerate_sizes():
    x = vectors(3000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, got = hnsw.Graph(x).search(x, 6)
    want = np.argsort(-(x @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(got, want)]) > 0.97
    for n in (1, 2, 5):
        s, i = hnsw.Graph(x[:n]).search(x[:n], 6)
        assert [set(r[r >= 0]) for r in i] == [set(range(n))] * n
    same = np.repeat(x[:1], 200, 0)
    _, i = hnsw.Graph(same).search(same, 6)
    assert (i >= 0).all()


def brute_neighbours(rows, width, k=5):
    seen = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and len(r[1]) == width and any(x for x in r[1]):
            seen[r[0]] = np.array([0 if x is None else x for x in r[1]], np.float64)
    ids = sorted(seen)
    x = np.array([seen[i] / np.linalg.norm(seen[i]) for i in ids])
    s = np.round(x @ x.T, 6)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
        out[i] = {ids[b] for b in order}
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_nearest_vectors(spark, shard_rows):
    width = 24
    rows = [(i + 1, [float(v) for v in x], "s", 0) for i, x in enumerate(vectors())]
    n = len(rows)
    rows += [(n + 1, None, "", 0), (n + 2, [0.0] * width, "", 0), (n + 3, [1.0] * 3, "", 0), (None, rows[0][1], "", 0), (n + 4, [None, *rows[3][1][1:]], "", 0)] + rows[:6]
    df = spark.createDataFrame(rows, "id long, v array<float>, shard string, role int")
    got = {}
    for r in neighbours.nearest_vectors(df, "id", "v", width, shard_rows=shard_rows).collect():
        got.setdefault(r.id, []).append(r.other)
    want = brute_neighbours(rows, width)
    assert set(got) == set(want) and all(len(v) == len(set(v)) <= 5 and i not in v for i, v in got.items())
    recall = np.mean([len(set(got[i]) & want[i]) / 5 for i in want])
    assert recall > (0.995 if shard_rows > n else 0.9)


def test_stored_graph_is_searched_alike():
    x = vectors(500)
    graph = hnsw.Graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    again = hnsw.Graph.from_arrays(graph.x, graph.layers, [r.astype(np.int32) for r in graph.rows])
    assert all((a == b).all() for a, b in zip(graph.search(graph.x, 6), again.search(graph.x, 6)))


def test_exact_neighbours(spark):
    x = vectors(300)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<float>")
    unit = neighbours.unit_vectors(df, "id", "v", 24)
    got = {}
    for r in neighbours.exact_neighbours(unit, unit.filter("id % 3 = 0"), 24, 5).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute_neighbours([(i, [float(v) for v in row]) for i, row in enumerate(x)], 24)
    assert set(got) == set(range(0, 300, 3)) and np.mean([len(got[i] & want[i]) / 5 for i in got]) > 0.99


def test_routing_keeps_recall_with_many_centres(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {}
    for r in neighbours.nearest_vectors(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 12, shard_rows=30).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute_neighbours(rows, 12)
    assert np.mean([len(got[i] & want[i]) / 5 for i in want]) >= 0.9


def test_copies_of_a_vector(spark):
    rng = np.random.default_rng(8)
    hot, near = rng.normal(size=24), rng.normal(size=24)
    rows = [(i, [float(v) for v in hot]) for i in range(1, 41)] + [(50, [float(v) for v in hot + 0.01 * near]), (60, [float(v) for v in near])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {}
    for r in neighbours.nearest_vectors(df, "id", "v", 24).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got[1] == {2, 3, 4, 5, 6} and got[20] == got[30] == {1, 2, 3, 4, 5} and got[50] == {1, 2, 3, 4, 5}
    assert len(got) == 42


def test_no_vectors(spark):
    assert neighbours.nearest_vectors(spark.createDataFrame([], "id long, v array<float>"), "id", "v", 24).count() == 0
