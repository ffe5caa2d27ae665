import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import categorise, cells, clustering, compaction, components, correlation, counts, demux, intervals, library, normalise, skew, statistics, umi


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- counts and fractions ------------------------------------------------------


def test_category_collapse(spark):
    df = spark.createDataFrame([("g", "genomic insertion", "x", "1"), ("g", "genomic insertion", "x", "2"), ("g", "donor", "a", "d"), ("g", "donor", "b", "d"), ("g", "deletion", "a", "d")], "guide string, category string, subcategory string, details string")
    assert rows(counts.outcome_counts(df, ["guide"])) == [("g", "deletion", "a", "d", 1), ("g", "donor", "collapsed", "d", 2), ("g", "genomic insertion", "x", "collapsed", 2)]
    assert counts.outcome_counts(df, ["guide"], collapsed=False).count() == 5


def _counts(spark):
    data = [("n1", True, "a", "x", "1", 6), ("n1", True, "a", "x", "2", 4), ("g1", False, "a", "x", "1", 2), ("g1", False, "b", "y", "1", 2)]
    return spark.createDataFrame(data, "guide string, is_nt boolean, category string, subcategory string, details string, n long")


def test_fold_changes_are_dense(spark):
    c = _counts(spark)
    guides = spark.createDataFrame([("n1",), ("g1",), ("none",)], "guide string")
    outs = c.select("category", "subcategory", "details").distinct()
    got = {(r.guide, r.category, r.details): r.log2_fc for r in normalise.log2_fold_changes(c, guides, outs).collect()}
    assert len(got) == 9
    assert got["g1", "a", "2"] == -5 and got["g1", "b", "1"] == math.inf and got["n1", "b", "1"] == 5
    assert got["g1", "a", "1"] == pytest.approx(math.log2(0.5 / 0.6)) and got["none", "a", "1"] is None
    assert got["n1", "a", "1"] == 0


def test_leftover_keeps_the_sum(spark):
    c = _counts(spark)
    common = spark.createDataFrame([("a", "x", "1")], "category string, subcategory string, details string")
    out = counts.with_leftover(c, common, ["guide"])
    assert out.agg(F.sum("n")).first()[0] == 14
    assert ("g1", "uncommon", "uncommon", "collapsed", 2) in rows(out)


def test_rollup_has_both_levels_and_controls(spark):
    got = rows(counts.category_counts(_counts(spark)).fillna("-"))
    assert ("all_non_targeting", "a", "-", 10) in got and ("g1", "a", "x", 2) in got and ("g1", "a", "-", 2) in got


def test_fractions_sum_to_one(spark):
    sums = normalise.outcome_fractions(_counts(spark)).groupBy("guide").agg(F.sum("fraction").alias("s")).collect()
    assert {r.guide for r in sums} == {"n1", "g1", "all_non_targeting"} and all(abs(r.s - 1) < 1e-12 for r in sums)


def test_split_lengths_keeps_rows_without_lengths(spark):
    c = spark.createDataFrame([("g", "genomic insertion", "x", "collapsed", 3), ("h", "genomic insertion", "x", "collapsed", 1), ("g", "deletion", "a", "d", 1)], "guide string, category string, subcategory string, details string, n long")
    lengths = spark.createDataFrame([("g", "x", 75, 2), ("g", "x", 76, 1)], "guide string, subcategory string, length int, n long")
    assert rows(counts.split_foreign_lengths(c, lengths)) == [("g", "deletion", "a", "d", 1), ("g", "genomic insertion", "x", "<=75 nts", 2), ("g", "genomic insertion", "x", ">75 nts", 1), ("h", "genomic insertion", "x", "collapsed", 1)]


# -- statistics -----------------------------------------------------------------


def test_gene_with_few_guides(spark):
    df = spark.createDataFrame([("a", "x", 1.0, True), ("b", "x", -3.0, True), ("c", "y", 2.0, True), ("d", "y", 9.0, False)], "guide string, gene string, log2_fc double, is_best_promoter boolean")
    got = {r.gene: r for r in statistics.gene_statistics(df).collect()}
    assert got["x"].lowest_1 == -3 and got["x"].lowest_3 == -1 and got["x"].extreme_1 == -3 and got["y"].highest_3 == 2


def test_k_of_n(spark):
    f = lambda n, k, p: spark.range(1).select(statistics.k_of_n_less(F.lit(n), F.lit(k), F.lit(p)).alias("x")).first().x
    assert f(5, 6, 0.5) == 1.0
    assert f(3, 1, 0.1) == pytest.approx(1 - 0.9**3)
    assert f(3, 3, 0.1) == pytest.approx(0.001)
    assert f(12, 9, 0.0) == 0.0


def test_chi_squared_corners(spark):
    guides = spark.createDataFrame([("n", True), ("g", False), ("empty", False)], "guide string, is_nt boolean")
    c = spark.createDataFrame([("n", "a", "x", "1", 10), ("g", "a", "x", "1", 5), ("g", "b", "x", "1", 5)], "guide string, category string, subcategory string, details string, n long")
    outs = spark.createDataFrame([("a", "x", "1"), ("b", "x", "1")], "category string, subcategory string, details string")
    got = dict(rows(statistics.chi_squared(c, guides, outs)))
    assert got == {"n": 0.0, "g": math.inf}


def test_blocks(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 1)], "i int, k int")
    assert rows(statistics.blocks(df, "k", [F.asc("i")])) == [(1, 0, 1), (1, 3, 3), (2, 2, 2)]


def test_nulls_are_reproducible(spark):
    df = spark.createDataFrame([(f"g{i % 5}", "ab"[i % 3 == 0]) for i in range(200)], "guide string, outcome string")
    a, b = (rows(statistics.resampled_nulls(df, 50, 20)) for _ in range(2))
    assert a == b and all(sum(n for s, _, n in a if s == k) == 50 for k in range(20))
    q = {r.outcome: r for r in statistics.null_quantiles(statistics.resampled_nulls(df, 50, 20), [0.5, 1.0], 20).collect()}
    assert q["a"].q1_0 == max(n for _, o, n in a if o == "a")


# -- molecules -------------------------------------------------------------------


def _umi_rows(spark, data):
    return spark.createDataFrame(data, "record_id long, guide string, umi string, category string, subcategory string, details string, num_reads long")


def test_winner_and_tie(spark):
    df = _umi_rows(spark, [(1, "g", "A", "d", "c", "1", 3), (2, "g", "A", "d", "c", "1", 4), (3, "g", "A", "i", "c", "1", 6), (4, "g", "B", "d", "c", "1", 5), (5, "g", "B", "i", "c", "1", 5)])
    won = umi.winners(umi.votes(df, ["guide", "umi"], "num_reads", "record_id"), ["guide", "umi"]).collect()
    assert [(r.umi, r.category, r.reads, r.representative) for r in won] == [("A", "d", 7, 2)]


def test_correction_follows_chains(spark):
    # C -> B -> A: neighbours differ in one place, A and C in two
    df = _umi_rows(spark, [(1, "g", "AAAA", "d", "c", "1", 10), (2, "g", "AAAT", "d", "c", "1", 5), (3, "g", "AATT", "d", "c", "1", 2), (4, "g", "GGGG", "d", "c", "1", 2), (5, "h", "AAAT", "d", "c", "1", 1), (6, "g", None, "d", "c", "1", 1)])
    got = {(r.guide, r.barcode): r.corrected for r in umi.correct_barcodes(df, ["guide"], "umi", "num_reads").collect()}
    assert got == {("g", "AAAA"): "AAAA", ("g", "AAAT"): "AAAA", ("g", "AATT"): "AAAA", ("g", "GGGG"): "GGGG", ("h", "AAAT"): "AAAT"}


def test_consensus_majority_low_quality_and_tie():
    assert umi.call_consensus(["AC", "AC", "AG"], ["II", "II", "II"]) == ("AC", "@@")
    assert umi.call_consensus(["A", "A"], ["#", "#"]) == ("A", "+")
    assert umi.call_consensus(["A", "C"], ["I", "I"]) == ("N", "#")
    assert umi.call_consensus(["ACG", "AC"], ["III", "II"])[0] == "ACG"


def test_clusters_of_reads():
    clusters = umi.cluster_reads(["AAAA", "AAAA", "AAAT", "CCCC"], ["IIII", "IIII", "III#", "IIII"])
    assert sorted((n, s) for s, _, n in clusters) == [(1, "CCCC"), (3, "AAAA")]
    assert umi.cluster_reads(["A"], ["I"]) == [("A", "@", 1)]


def test_collapse_reads(spark):
    df = spark.createDataFrame([(1, "u", "AAAA", "IIII"), (2, "u", "AAAA", "IIII"), (2, "u", "AAAA", "IIII"), (3, "v", "CCCC", "IIII"), (4, None, "CCCC", "IIII"), (5, "u", None, None), (6, "u", "TTTT", "IIII")], "id long, umi string, seq string, qual string")
    got = rows(umi.collapse_reads(df, ["umi"], "id", "seq", "qual").select("umi", "cluster_id", "num_reads", "seq"))
    assert got == [("u", 0, 2, "AAAA"), ("u", 1, 1, "TTTT"), ("v", 0, 1, "CCCC")]


# -- demultiplexing and library ----------------------------------------------------


def test_demux_exact_one_two_and_ambiguous(spark):
    names = spark.createDataFrame([("a", "AAAA"), ("b", "AATT"), ("c", "GGGG")], "name string, seq string")
    reads = spark.createDataFrame([(1, "AAAA"), (2, "GGGC"), (3, "GGCC"), (4, "AAAT"), (5, None), (6, "gggg")], "id int, s string")
    got = dict(rows(demux.assign(reads, F.col("s"), demux.resolver(names, "name", "seq"), "who").select("id", "who")))
    assert got == {1: "a", 2: "c", 3: "unknown", 4: "unknown", 5: "unknown", 6: "c"}


def test_two_indices(spark):
    table = spark.createDataFrame([("s1", "AAA", "CCC"), ("s2", "AAA", "GGG")], "name string, i7 string, i5 string")
    reads = spark.createDataFrame([(1, "AAA", "CCC"), (2, "AAT", "GGC"), (3, "TTT", "CCC")], "id int, a string, b string")
    got = dict(rows(demux.assign_by_two(reads, F.col("a"), F.col("b"), demux.resolver(table, "name", "i7"), demux.resolver(table, "name", "i5"), "s").select("id", "s_key")))
    assert got == {1: "s1", 2: "s2", 3: "TTT+CCC"}


def _library(spark):
    return spark.createDataFrame([(" a_1", "A", None, 1), ("A_2", "A", "P1", 2), ("n_1", "non-targeting", None, 1), ("n_2", "non-targeting", None, 2)], "short_name string, gene string, promoter string, guide_rank int").withColumns({"protospacer": F.lit("x"), "full_seq": F.lit("x"), "guide_barcode": F.lit("x"), "gamma": F.lit(None).cast("double")})


def test_promoters_and_sets(spark):
    preferred = spark.createDataFrame([("A", "P1")], "gene string, best_promoter string")
    dim = library.guide_dimension(_library(spark), preferred)
    assert {r.guide: (r.promoter, r.is_best_promoter) for r in dim.collect()} == {"A_1": ("P1P2", False), "A_2": ("P1", True), "N_1": ("P1P2", True), "N_2": ("P1P2", True)}
    assert rows(library.control_sets(dim, 2)) == [("non_targeting_set_0", "N_1"), ("non_targeting_set_0", "N_2")]
    with pytest.raises(ValueError):
        library.control_sets(dim, 3)
    assert library.guide_dimension(_library(spark), excluded=["N_2"]).count() == 3


def test_unique_names(spark):
    genes = spark.createDataFrame([("e1", "X", 1), ("e1", "Y", 2), ("e2", "X", 3)], "gene_id string, name string, seen int")
    assert rows(library.unique_display_names(genes)) == [("e1", "X"), ("e2", "X_2")]


# -- intervals, correlation, clusters ------------------------------------------------


def test_coverage_of_nested_and_touching(spark):
    df = spark.createDataFrame([(1, 5, 2), (2, 3, 1), (6, 7, 4)], "start int, stop int, n long").withColumn("k", F.lit(0))
    dense = intervals.dense_coverage(df, ["k"], "start", "stop", "n", 0, 8, df.select("k").distinct())
    assert [c for _, _, c in rows(dense)] == [0, 2, 3, 3, 2, 2, 4, 4, 0]
    sparse = {r.position: (r.covered, r.starts, r.stops) for r in intervals.coverage(df, ["k"], "start", "stop", "n").collect()}
    assert sparse[2] == (3, 1, 0) and sparse[5] == (2, 0, 2) and sparse[8] == (0, 0, 0)


@pytest.mark.parametrize("length,want", [(-1, 1050), (999, 999), (1000, 1000), (1050, 1000), (None, 1050)])
def test_capped_length(spark, length, want):
    assert spark.createDataFrame([(length,)], "l int").select(intervals.capped_length(F.col("l")).alias("x")).first().x == want


def test_covered_length(spark):
    df = spark.createDataFrame([([(1, 5), (2, 3), (5, 6), (9, 9)],), ([],)], "x array<struct<start:int,stop:int>>")
    assert [r.c for r in df.select(intervals.covered_length(F.col("x")).alias("c")).collect()] == [7, 0]


def test_constant_item_has_null_correlation(spark):
    df = spark.createDataFrame([(g, i, float(v)) for g, vs in {"a": [1, 2, 3], "b": [2, 4, 7], "c": [1, 1, 1]}.items() for i, v in enumerate(vs)], "g string, i int, x double")
    got = {(r.a, r.b): r.r for r in correlation.correlations(df, "g", ["i"], "x").collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1]) and got["a", "c"] is None


def test_single_linkage_and_density():
    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])
    d = np.abs(x[:, None] - x[None, :])
    merges = clustering.single_linkage(d)
    assert list(clustering.cut_tree(merges, 6, 3)) == [0, 0, 0, 1, 1, 2]
    assert sorted(clustering.leaf_order(merges, 6, d)) == list(range(6))
    x[5] = 100.0  # leaves the whole before it parts, so it is in no cluster
    labels = clustering.density_clusters(np.abs(x[:, None] - x[None, :]), min_size=2, epsilon=0.5)
    assert labels[0] == labels[1] == labels[2] != labels[3] == labels[4] and labels[0] >= 0 and labels[5] == -1


def test_hierarchical_operator(spark):
    pairs = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.9), ("b", "c", 0.8)], "a string, b string, distance double")
    got = {r.item: r.cluster_id for r in clustering.hierarchical(pairs, "distance", 2).collect()}
    assert got["a"] == got["b"] != got["c"]


# -- categories ------------------------------------------------------------------------


def _read(al, seq="A" * 120, qual=None):
    return (seq, qual or "I" * len(seq), al)


def test_decision_order(spark):
    target = categorise.Target(cut=50, primers=((0, 9), (110, 119)))
    al = lambda **k: {**{"ref": "target", "q_start": 0, "q_end": 119, "r_start": 0, "r_end": 119, "strand": "+", "edits": 0, "indels": []}, **k}
    dele = {"kind": "D", "start": 48, "length": 5}
    cases = [
        (_read([]), "bad sequence"),
        (_read([al(q_end=39)], "A" * 40), "nonspecific amplification"),
        (_read([al()]), "wild type"),
        (_read([al(r_start=30)]), "truncation"),
        (_read([al(edits=1)]), "mismatches"),
        (_read([al(indels=[dele])]), "deletion"),
        (_read([al(indels=[{"kind": "I", "start": 50, "length": 2}])]), "insertion"),
        (_read([al(indels=[{"kind": "D", "start": 90, "length": 2}])]), "wild type"),
        (_read([al(indels=[{"kind": "D", "start": 90, "length": 9}])]), "uncategorized"),
        (_read([al(indels=[dele, dele])]), "multiple indels"),
        (_read([al(q_end=40), al(ref="hg19", q_start=41)]), "genomic insertion"),
        (_read([al(q_end=60, r_end=60), al(q_start=61, r_start=50)]), "duplication"),
        (_read([al(ref="phiX", q_start=30)]), "phiX"),
        (_read([al(q_start=30, q_end=60)], "A" * 120, "#" * 120), "bad sequence"),
    ]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], f"i int, seq string, qual string, alignments array<{categorise.ALIGNMENT}>")
    got = {r.i: r.category for r in categorise.categorise(df, target).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_change_summary(spark):
    df = spark.createDataFrame([("ACGT", (0, 0))], "seq string, a struct<q_start:int,r_start:int>").withColumn("al", F.struct(F.lit(0).alias("q_start"), F.lit(0).alias("r_start"), F.lit(2).alias("r_end")))
    assert df.select(categorise.change_summary(F.col("seq"), F.col("al"), ((1, "T"), (2, "A"), (3, "G")), "ATCC").alias("x")).first().x == "CG-"


def test_templated_candidates(spark):
    df = spark.createDataFrame([("r", 1, 0, 0, 30, "genome"), ("r", 0, 1, 0, 30, "donor"), ("r", 0, 0, 0, 20, "genome"), ("s", 6, 0, 0, 90, "donor")], "read string, edits int, gap_before int, gap_after int, length int, source string")
    assert [(r.read, r.source, r.edits) for r in categorise.templated_candidates(df, "read").collect()] == [("r", "genome", 1)]


# -- cells -------------------------------------------------------------------------------


def test_cells(spark):
    df = spark.createDataFrame([("c1", "a", 3), ("c1", "b", 3), ("c2", "a", 1)], "cell string, feature string, n long")
    assert rows(cells.cell_metrics(df)) == [("c1", 6, 3, "b", 0.5), ("c2", 1, 1, "a", 1.0)]


def test_mixture_separates(spark):
    rng = np.random.default_rng(3)
    data = [(f"c{i}", "g", int(x)) for i, x in enumerate([*rng.poisson(1.0, 300), *rng.normal(200, 30, 60)])]
    called = cells.mixture_calls(spark.createDataFrame(data, "cell string, feature string, n long"))
    n = called.filter("is_called").count()
    assert 55 <= n <= 66
    assert called.select("threshold").distinct().count() == 1


def test_bootstrap_replicate_zero_is_the_data(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0), ("b", 3.0, 4.0)], "g string, x double, y double").withColumn("i", F.monotonically_increasing_id())
    got = cells.bootstrap_fractions(df, "g", "x", "y", 5).filter("replicate = 0")
    assert dict((r.guide, r.fraction) for r in got.collect()) == {"a": 0.5, "b": 0.75}


# -- components -----------------------------------------------------------------------------


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (5, 5), (None, 7), (20, 19), (19, 18), (18, 20)]
    got = rows(components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b"))
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10), (18, 18), (19, 18), (20, 18)]
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)]
    got = components.connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").groupBy("component").count()
    assert rows(got) == [(0, 201), (1000, 301)]


# -- heavy keys --------------------------------------------------------------------------------


def brute(data):
    out = {}
    seen = {}
    for k, r, v in data:
        seen[k, r] = max(seen.get((k, r), 0), v or 0)
    for (k, _), v in seen.items():
        n, s = out.get(k, (0, 0))
        out[k] = (n + 1, s + v)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_totals_split_over_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    data = [("hot", int(r), int(rng.integers(0, 9))) for r in rng.integers(0, 900, 1500)] + [(f"k{int(k)}", int(r), None if r % 7 == 0 else int(r)) for k, r in zip(rng.integers(0, 40, 500), rng.integers(0, 60, 500))] + [(None, 1, 5), (None, 1, 5), ("one", 3, 2)]
    # a record delivered very often, all copies alike
    data += [("hot", 77, 3)] * 1000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(data, "key string, rid long, value long").withColumn("total", F.lit("clash")).repartition(5)
        got = {r.key: (r.n_records, int(r.total)) for r in skew.totals_per_key(df, F.col("key"), F.col("rid"), F.col("value")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute(data)


def test_heavy_keys_and_empty(spark):
    data = [("a", i, 0) for i in range(19)] + [("b", 100, 5)]
    t = skew.totals_per_key(spark.createDataFrame(data, "k string, r long, v long"), F.col("k"), F.col("r"), F.col("v"))
    assert {r.key: r.is_heavy for r in skew.heavy_keys(t).collect()} == {"a": True, "b": True}
    assert {r.key: r.is_heavy for r in skew.heavy_keys(t, 0.5).collect()} == {"a": True, "b": True}
    empty = skew.totals_per_key(spark.createDataFrame([], "k string, r long, v long"), F.col("k"), F.col("r"), F.col("v"))
    assert skew.heavy_keys(empty).count() == 0


# -- small files ---------------------------------------------------------------------------------

STORE = "id long, quartet string, chunk int, text string, at timestamp, `odd name` double, line string"


def _store(spark):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s, 123456)
    data = [
        (1, "q1", 1, "a", t(1), 1.5, "x"),
        (2, "Q1 ", 1, None, t(1), None, None),
        (3, "q1", 2, "", t(1), 0.1, "y"),
        (3, "q1", 2, "", t(2), 0.1, "y"),  # twice in a chunk
        (4, "q1", 3, "u\n\"ü€", t(1), 2.0, "z"),
        (4, "q2", 1, "u\n\"ü€", t(5), 2.0, "z"),  # in two chunks
        (5, "q2", 1, "long" * 5000, t(1), 3.0, "z"),
        (None, "q2", 2, "no id", t(1), 3.0, "z"),
        (None, "q2", 2, "no id either", t(1), 3.0, "z"),
        (6, None, None, "no file", t(1), 3.0, "z"),
        *[(100 + i, "big", 1, f"row {i}", t(1), float(i), "z") for i in range(300)],
    ]
    return spark.createDataFrame(data, STORE)


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_archive_round_trip(spark, block):
    store = _store(spark)
    archive = compaction.pack_files(store, "quartet", "chunk", "id", ["at"], block_bytes=block)
    back = archive.records()
    key = lambda r: tuple(str(x) for x in r)
    want = sorted((key(r) for r in store.collect() if not (r.id == 3 and r["at"].second == 2) and not (r.id == 4 and r.quartet == "q2")))
    assert sorted(key(r) for r in back.collect()) == want
    index = archive.index()
    # segments of a file are complete and none is above the block but a single long record
    big = [r for r in index.filter("grp = 'BIG'").orderBy("segment").collect()]
    assert sum(r.n_records for r in big) == 300
    for r in archive.blocks.collect():
        assert r.n_bytes == len(r.payload) and (r.n_bytes <= block or len(r.members) == 1)
        at = 0
        for m in r.members:
            assert m.offset == at
            at += m.length
        assert at == r.n_bytes


def test_archive_other_join_path(spark):
    store = _store(spark)
    a = compaction.pack_files(store, "quartet", "chunk", "id", ["at"], broadcast_rows=0)
    assert a.records().count() == store.count() - 2


def test_corrupt_block_is_found(spark):
    archive = compaction.pack_files(_store(spark), "quartet", "chunk", "id", ["at"])
    broken = compaction.Archive(archive.blocks.withColumn("payload", F.concat(F.lit("X"), F.substring("payload", 2, 1 << 30)).cast("binary")), archive.files, archive.record_schema)
    with pytest.raises(Exception, match="checksum"):
        broken.records().collect()


def test_file_report(spark):
    listing = spark.createDataFrame([("q1", 1, 2), ("q1", 1, 2), ("q1 ", 2, 1), ("Q1", 3, 1), ("q2", 1, 2), ("q2", 2, None), ("gone", 9, 1), ("big", 1, 299)], "quartet string, chunk int, n int")
    report = compaction.file_report(compaction.pack_files(_store(spark), "quartet", "chunk", "id", ["at"]), listing, "quartet", "chunk", "n")
    got = {(r.grp, r.num): (r.is_repeated, r.is_miscounted, r.is_missing) for r in report.collect()}
    assert got == {("Q1", 1): (False, False, False), ("Q1", 2): (True, False, False), ("Q1", 3): (True, False, False), ("Q2", 1): (True, False, False), ("Q2", 2): (False, True, False), ("GONE", 9): (False, False, True), ("BIG", 1): (False, True, False), (None, None): (False, False, True)}


def test_empty_store(spark):
    archive = compaction.pack_files(spark.createDataFrame([], STORE), "quartet", "chunk", "id", ["at"])
    assert archive.blocks.count() == 0 and archive.records().count() == 0 and archive.manifest().count() == 0


@pytest.mark.parametrize("block", [1 << 20, 100, 7])
def test_stored_files_come_back_byte_by_byte(spark, tmp_path, block):
    want = {f"f{i:02d}": bytes((i * 37 + j) % 256 for j in range([0, 1, 5, 250, 30][i % 5])) for i in range(12)}
    for name, data in want.items():
        (tmp_path / name).write_bytes(data)
    blocks = compaction.pack_stored_files(spark, str(tmp_path), block, task_bytes=400)
    assert max(len(r.payload) for r in blocks.collect()) <= block
    got = {}
    for r in sorted(compaction.stored_segments(blocks).collect(), key=lambda r: (r.path, r.segment)):
        got[r.path.split("/")[-1]] = got.get(r.path.split("/")[-1], b"") + bytes(r.content)
    assert got == {k: v for k, v in want.items() if v}
    one = blocks.select(F.explode("members.path").alias("path")).filter("path like '%f03'").distinct()
    assert b"".join(bytes(r.content) for r in sorted(compaction.stored_segments(blocks, one).collect(), key=lambda r: r.segment)) == want["f03"]
    broken = blocks.withColumn("payload", F.concat(F.lit("X"), F.col("payload")).cast("binary"))
    with pytest.raises(Exception, match="checksum"):
        compaction.stored_segments(broken).collect()


def test_tasks_follow_the_bytes(spark):
    rows = spark.range(1000).select("id", F.lit("Q").alias("quartet"), F.lit(1).alias("chunk"), F.repeat(F.lit("x"), 500).alias("text"), F.current_timestamp().alias("at"))
    archive = compaction.pack_files(rows, "quartet", "chunk", "id", ["at"], task_bytes=50_000)
    tasks = [r[0] for r in archive.blocks.groupBy(F.substring("block_id", 1, 6)).agg(F.sum("n_bytes").alias("n")).select("n").collect()]
    assert len(tasks) >= 8 and max(tasks) < 200_000 and archive.records().count() == 1000


def test_ranked_over_all(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("v"), "id").repartition(7)
    got = counts.ranked_over_all(df, [F.desc("v"), F.asc("id")]).collect()
    want = sorted(((i * 37 % 101, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1, 501))
    assert counts.ranked_over_all(df.limit(0), [F.asc("id")]).count() == 0
