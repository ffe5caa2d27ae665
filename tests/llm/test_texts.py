"""Frequent items, containers, leaked passages and template residue."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import heavy_items, leakage, packing, residue
from tessera.llm.literals import fold
from tessera.session import materialize

# -- frequent items ------------------------------------------------------------------


def zipf(n, distinct, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.zipf(1.3, n) % distinct).astype(np.int64)


def test_sketch_bounds_hold_and_memory_does_not_grow():
    x = zipf(300_000, 200_000)
    sketch = heavy_items.HeavyLight()
    for part in np.array_split(x, 17):
        sketch.add(*np.unique(part, return_counts=True))
    items, true = np.unique(x, return_counts=True)
    true = dict(zip(items.tolist(), true.tolist()))
    assert sketch.item.shape == (heavy_items.TABLES, heavy_items.BUCKETS)
    for t in range(heavy_items.TABLES):
        assert int(sketch.votes[t].sum() + sketch.light[t].sum()) == len(x)
        at = np.flatnonzero(sketch.votes[t])
        low, keys = sketch.votes[t, at], sketch.item[t, at]
        up = low + sketch.light[t, heavy_items.counter_slot(keys)]
        assert all(a <= true[k] <= b for a, b, k in zip(low.tolist(), up.tolist(), keys.tolist()))
        assert {k for k, v in true.items() if v >= 3000} <= set(keys.tolist())


def test_frequent_items_operator(spark):
    rng = random.Random(2)
    rows = []
    for i in range(5000):
        v = "hot" if i % 3 == 0 else "warm" if i % 40 == 1 else f"rare{rng.randint(0, 10**9)}"
        rows.append((i, v, None if i % 10 == 0 else str(i % 7), "clash"))
    rows += rows[:700] + [(6000, None, "0", ""), (6001, "", "", "")]
    df = spark.createDataFrame(rows, "id long, v string, w string, item string").repartition(6)
    items = {"v": F.col("v"), "w": F.col("w")}
    cand, distinct, total = heavy_items.frequent_items(df, "id", items, 0.01, materialize)
    got = {(r.field, r.item): (r.n_records, r.lower, r.upper) for r in heavy_items.exact_counts(cand, distinct, df, items).collect() if r.n_records >= 0.01 * total}
    seen = {r[0]: r for r in rows}
    want = {}
    for r in seen.values():
        for f, v in (("v", r[1]), ("w", r[2])):
            if v is not None:
                want[f, v] = want.get((f, v), 0) + 1
    want = {k: n for k, n in want.items() if n >= 0.01 * len(seen)}
    assert total == len(seen) and {k: v[0] for k, v in got.items()} == want
    assert all(low <= n <= up for n, low, up in got.values())


def test_frequent_items_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v string")
    cand, _, total = heavy_items.frequent_items(df, "id", {"v": F.col("v")}, 0.01, materialize)
    assert cand.count() == 0 and total == 0


# -- containers ------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=200))
def test_containers_are_never_overfull(sizes):
    sizes = np.array(sizes, np.int64)
    where = packing.fill_containers(sizes, 100)
    assert (where >= 0).all() or not len(sizes)
    load = np.bincount(where, weights=sizes) if len(sizes) else np.zeros(0)
    assert (load <= 100).all()
    large = np.bincount(where[sizes * 3 > 100]) if (sizes * 3 > 100).any() else np.zeros(0)
    assert (large <= 2).all()
    # no two of the containers without large items could be one
    assert len(load) <= 2 * -(-int(sizes.sum()) // 100) + 1


def test_packing_keeps_every_token(spark):
    rng = random.Random(4)
    texts = [" ".join(["w"] * rng.choice([0, 1, 30, 200, 340, 342, 500, 800, 1024, 1025, 2048, 5000])) for _ in range(300)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (None, "a b", 1), (None, "a b", 1), (0, "c d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp int")
    out = packing.pack_texts(df, "doc_id", packing.rule_tokens(F.col("text")), 1024, group_rows=100).collect()
    total = {}
    for r in out:
        total[r.container_id] = total.get(r.container_id, 0) + r.n_tokens
    assert max(total.values()) <= 1024
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[None]) == 2 and sum(r.n_tokens for r in by[0]) == len(texts[0].split()) + 2
    for i, t in enumerate(texts[1:], 1):
        parts = sorted(by[i], key=lambda r: r.piece)
        n = len(t.split())
        assert sum(r.n_tokens for r in parts) == n and len(parts) == max(1, -(-n // 1024))
        assert all(r.n_tokens == 1024 and r.start_token == r.piece * 1024 for r in parts[:-1])
    assert by[900][0].n_tokens == by[901][0].n_tokens == 0
    report = packing.fill_report(packing.pack_texts(df, "doc_id", packing.rule_tokens(F.col("text")))).first()
    assert report.largest <= 1024 and report.filled > 0.95


@pytest.mark.parametrize("text,n", [("ab c1,d", 4), ("a\tb\r\nc", 3), ("é日x", 3), ("", 0), (None, 0), (" ", 1), ("😀😀", 2)])
def test_token_rule(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(packing.rule_tokens(F.col("t")).alias("n")).first().n == n


def test_vocabulary_tokens(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    texts = ["Hello world", "", None, "naïve <|endoftext|>"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(packing.vocabulary_tokens(F.col("t"), path).alias("n")).collect()]
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    assert got == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_no_documents(spark):
    assert packing.pack_texts(spark.createDataFrame([], "doc_id long, text string"), "doc_id", packing.rule_tokens(F.col("text"))).count() == 0


# -- leaked passages ------------------------------------------------------------------------


def plain_distance(pattern, text):
    d = [list(range(len(pattern) + 1))]
    best = len(pattern)
    for w in text:
        row = [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(d[-1][i] + 1, row[i - 1] + 1, d[-1][i - 1] + (p != w)))
        d.append(row)
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=20))
def test_bit_parallel_distance(pattern, text):
    assert leakage.myers(pattern, text) == plain_distance(pattern, text)


def corpus():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 13, 40])))) for i in range(30)]
    items += [(100, items[4][1] + " tail"), (101, None), (102, ""), (None, items[2][1])]
    docs = []
    for d in range(300):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            it = items[rng.randint(0, 29)][1].split()
            k = rng.choice([11, 12, 20])
            a = rng.randint(0, max(0, len(it) - k))
            cut = it[a : a + k]
            if d % 9 == 0 and len(cut) > 6:
                cut[5] = "changed"
            words[len(words) // 2 : len(words) // 2] = cut
        sep = rng.choice([" ", ", ", "\n> ", " <b> ".replace("b", "-")])
        text = sep.join(words)
        docs.append((d, text.upper() if d % 2 else text, 5))
    docs += [(1000, None, 5), (1001, "", 5), (None, items[3][1], 5), (1002, "İK" + " ".join(vocab[:9]), 5)]
    return docs + docs[:4], items + items[:2]


def brute_leaks(docs, items):
    out = set()
    for i, t in items:
        w = leakage.words_of(t)
        for d, text, _ in docs:
            if i is None or d is None or text is None or t is None:
                continue
            v = leakage.words_of(text)
            grams = {tuple(v[k : k + 12]) for k in range(len(v) - 11)}
            if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                out.add((i, d))
    return out


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_leaked_items(spark, limit):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, edits int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = leakage.leaked_items(d, i, broadcast_bytes=limit).collect()
    assert len(got) == len({(r.item_id, r.doc_id) for r in got})
    assert {(r.item_id, r.doc_id) for r in got if r.edits == 0} == brute_leaks(docs, items)
    # one changed word, and an unchanged half: within the budget
    close = {(r.item_id, r.doc_id) for r in got if r.edits == 1}
    want = set()
    for a, t in {x for x in items if x[0] is not None and x[1]}:
        w = leakage.words_of(t)
        for b, text, _ in docs:
            v = leakage.words_of(text)
            if b is not None and len(w) >= 12 and min((plain_distance(w[k : k + 12], v) for k in range(len(w) - 11)), default=99) == 1:
                want.add((a, b))
    assert close == want


def test_words_are_ascii_only():
    assert leakage.words_of("Ab-1é2 K") == [b"ab", b"1", b"2"]


def test_nothing_to_leak(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaked_items(d, i).count() == 0


def test_rows_of_one_id_are_spread(spark):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), (F.col("id") % 50).alias("n"), F.lit(1).alias("grp"))
    got = packing.pack_texts(df, "doc_id", F.col("n"), 100, group_rows=500)
    groups = [r[0] for r in got.groupBy(F.shiftright("container_id", 32)).agg(F.count("*").alias("n")).select("n").collect()]
    assert len(groups) == 6 and sum(groups) == 3000 and max(groups) < 700
    loads = [r[0] for r in got.groupBy("container_id").agg(F.sum("n_tokens")).select("sum(n_tokens)").collect()]
    assert max(loads) <= 100 and sum(loads) == sum(i % 50 for i in range(3000)) and sum(loads) >= 0.97 * 100 * len(loads)


def test_whole_report(spark):
    df = spark.createDataFrame([(1, 250), (2, 100), (3, 40), (4, 0)], "doc_id long, n long")
    packed = packing.pack_texts(df, "doc_id", F.col("n"), 100)
    assert packing.whole_report(packed, 100).first().asDict() == {"texts": 4, "tokens": 390, "texts_over": 1, "cut_in_vain": 0, "with_gaps": 0, "overfull": 0}
    broken = packed.withColumn("n_tokens", F.when(F.col("doc_id") == 3, 140).otherwise(F.col("n_tokens")))
    assert packing.whole_report(broken, 100).first()["overfull"] == 1


# -- template residue --------------------------------------------------------------------------

CASES = [
    ("Dear {{first_name}},\n\nthe results are ready.", "placeholder"),
    ("The screen ${POOL} was run by @@pool@@ on lane 3.", "placeholder"),
    ("Welcome back <%= date %>! You have %(name)s new pools.", "placeholder"),
    ("Contact: __TITLE__", "placeholder"),
    ("Run report for $SAMPLE$", "placeholder"),
    ("Operator: [hier sample eintragen]", "placeholder"),
    ("Reads: (fill in batch)", "placeholder"),
    ("# [TITLE TO BE COMPLETED]", "placeholder"),
    ("Date: [object Object]", "placeholder"),
    ("Regards\n<EMAIL>", "placeholder"),
    ("lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
    ("xxx xxx xxx xxx xxx xxx", "filler"),
    ("Texto de relleno. Aquí va la descripción.", "filler"),
    ("This is sample text. Replace it with the description.", "filler"),
    ("404 Not Found", "error"),
    ("Home | Runs\n\nError 503: service unavailable.\n\nImprint", "error"),
    ("Traceback (most recent call last):\n  File \"a.py\", line 3, in f\nKeyError: 1", "error"),
    ("Something went wrong on our side. Reference 5.", "error"),
    ("Seite nicht gefunden. Die Adresse existiert nicht.", "error"),
    ("Please enable JavaScript to continue.", "scripts"),
    ("<noscript>This works with scripts only.</noscript>", "scripts"),
    ("Veuillez activer JavaScript pour afficher cette page.", "scripts"),
    # nothing of the kind, or only spoken about
    (None, None),
    ("", None),
    ("Lane 2 held exactly 404 reads with an ambiguous barcode, which is fine.", None),
    ("In the naming scheme, ${operator} stands for the lane, as the manual says.", None),
    ("The sheet loader replaces {{batch}} by the value from the config.", None),
    ("Python users can write \"%(run_id)s\" in the naming rule.", None),
    ("When the sheet came back with <SCREEN NAME> still in it, we filled it in and sent it again.", None),
    ("The mask [ACGT]{4}N was used to trim the count matrix.", None),
    ("The slide template used to contain lorem ipsum in its footer, and we removed it before the talk.", None),
    ("A user asked what the message \"enable JavaScript\" means; we told them to use the export.", None),
    ("We fixed the bug in which the portal answered with error 404 whenever a name held a slash.", None),
    ("Access to the cold room is forbidden after eight.", None),
    ("Use it like this:\n```\nprint(f\"{{name}} ${x}\")\n```\nand run.", None),
    ("The placeholder plasmid carries no guide and serves as a filler for the lane.", None),
    ("ACAC ACAC ACAC ACAC ACAC ACAC", None),
    ("foo,foo,foo,foo,foo,foo", "filler"),
    ("Blah, blah. Blah; blah, BLAH! blah", "filler"),
    ("The entry you were looking for has been deleted.", "error"),
    ("Our engineers have been notified.", "error"),
    ("The record you asked for is attached, with the counts.", None),
    ("The loader replaces  <%= date %>  and {{ name }}  by the values of the sheet.", None),
]


@pytest.mark.parametrize("text,kind", CASES)
def test_residue_kind(text, kind):
    assert residue.residue_kind(text) == kind


def test_residue_in_long_texts(spark):
    long = "The median was 5 reads. " * 20_000
    rows = [(1, long, 0), (2, long + "Dear {{name}}, hello.", 0), (None, "404 Not Found", 0), (3, None, 0), (4, "404 Not Found", 0), (4, "404 Not Found", 0)]
    got = sorted((r.doc_id or 0, r.kind) for r in residue.template_residue(spark.createDataFrame(rows, "doc_id long, text string, kind int")).collect())
    assert got == [(0, "error"), (2, "placeholder"), (4, "error"), (4, "error")]


def test_hints_cover_all_cases():
    for text, kind in CASES:
        if kind:
            assert any(h in fold(text) for h in residue.HINTS) or residue._repeats(fold(text))


def test_all_is_found_without_hints(monkeypatch):
    with_hints = [residue.residue_kind(text) for text, _ in CASES]
    monkeypatch.setattr(residue, "_holds", lambda low, hints: True)
    monkeypatch.setattr(residue, "_repeats", lambda low: True)
    assert [residue.residue_kind(text) for text, _ in CASES] == with_hints
