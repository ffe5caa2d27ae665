import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import dna, outcomes, ratios, special


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("a,b,want", [("ACGT", "ACGT", 0), ("ACGT", "ACGA", 1), ("", "", 0), ("AC", "ACG", None), (None, "A", None)])
def test_hamming(spark, a, b, want):
    assert one(spark, dna.hamming(F.col("a"), F.col("b")), a=a, b=b) == want


def test_reverse_complement_keeps_other_letters(spark):
    assert one(spark, dna.reverse_complement(F.col("s")), s="AACGTN") == "NACGTT"


def test_phred_round_trip(spark):
    assert one(spark, dna.phred(F.col("q")), q="!#I") == [0, 2, 40]
    assert one(spark, dna.phred_string(dna.phred(F.col("q"))), q="!#I") == "!#I"
    assert one(spark, dna.phred(F.col("q")), q="") == []


def test_quality_hamming_needs_both(spark):
    col = dna.quality_hamming(F.col("a"), F.col("b"), F.col("x"), F.col("y"), 30)
    assert one(spark, col, a="AAAA", b="CCCA", x="?#?I", y="??#I") == 1


def test_seed_mismatches_over_the_read(spark):
    assert one(spark, dna.seed_mismatches(F.col("s"), F.col("r"), F.col("q"), 20), s="ACGTACGT", r="ACCA", q="IIII") == 2
    assert one(spark, dna.seed_mismatches(F.col("s"), F.col("r"), F.col("q"), 20), s="ACGTACGT", r="ACCA", q="II#I") == 1


@pytest.mark.parametrize("seq,qual,want", [("ACGT", "####", -1), ("ACGA", "IIII", 3), ("ACGA", "III>", -1), ("ACGA", "III?", 3), ("TCGA", "IIII", None), ("TCGA", "#III", 3)])
def test_guide_mismatch(spark, seq, qual, want):
    # ">" is quality 29, "?" is 30
    assert one(spark, dna.classify_guide(F.col("s"), F.lit("ACGT"), F.col("q")), s=seq, q=qual) == want


def test_variants(spark):
    got = one(spark, dna.variants_within_one(F.col("s"), "ACGT"), s="AC")
    assert sorted(got) == sorted({"AC", "CC", "GC", "TC", "AA", "AG", "AT"})


def test_runs_and_counts(spark):
    assert one(spark, dna.longest_run(F.col("s"), "G"), s="GGAGGGA") == 3
    assert one(spark, dna.longest_run(F.col("s"), "G"), s="AAA") == 0
    assert one(spark, dna.count_letter(F.col("s"), "N"), s="NANN") == 3
    assert one(spark, dna.quality_fraction(F.col("q")), q="?>??") == 0.75
    assert one(spark, dna.quality_fraction(F.col("q"), second_half=True), q="##?>") == 0.5
    assert one(spark, dna.quality_fraction(F.col("q")), q="") is None


def test_trim_to_prefix(spark):
    assert one(spark, dna.trim_to_prefix(F.col("s"), "GG"), s="AAGGTT") == "GGTT"
    assert one(spark, dna.trim_to_prefix(F.col("s"), "GG"), s="A" * 11 + "GGTT") == "A" * 11 + "GGTT"


def test_outcome_grammar(spark):
    text = "D:118,4;I:118,ACG"
    assert one(spark, outcomes.deletion_start(F.col("d")), d=text) == 118
    assert one(spark, outcomes.deletion_length(F.col("d")), d=text) == 4
    assert one(spark, outcomes.inserted_bases(F.col("d")), d=text) == "ACG"
    assert one(spark, outcomes.change_place(F.col("d")), d=text) is None
    assert one(spark, outcomes.change_base(F.col("d")), d="S:96A") == "A"
    assert one(spark, outcomes.foreign_length(F.col("d")), d="<=75 nts") is None
    assert one(spark, outcomes.duplication_length(F.col("d")), d="U:97,43") == 43


def test_deletion_geometry(spark):
    row = spark.createDataFrame([(8, 5)], "s int, l int").select(outcomes.removed_left(F.col("s"), F.col("l"), 10).alias("a"), outcomes.removed_right(F.col("s"), F.col("l"), 10).alias("b"), outcomes.directionality(F.col("s"), F.col("l"), 10).alias("c"), outcomes.flip(outcomes.flip(F.col("s"), F.col("l"), 10), F.col("l"), 10).alias("d"), outcomes.shift(F.col("s"), 10).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (3, 2, "bidirectional", 8, -2)


def test_fold_change_corners(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 0.5), (0.5, 0.0), (0.5, 0.25), (None, 0.5)], "f double, b double")
    got = [r.x for r in rows.select(ratios.log2_fold_change(F.col("f"), F.col("b")).alias("x")).collect()]
    assert got == [5.0, -5.0, math.inf, 1.0, None]
    clamped = [r.x for r in rows.select(ratios.clamped_log2(F.col("f"), F.col("b")).alias("x")).collect()]
    assert clamped == [None, -5.0, 5.0, 1.0, None]


def exact_cdf(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(0, k + 1)))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 50), st.data())
def test_binomial_tails_against_exact_sums(n, data):
    k, p = data.draw(st.integers(0, n)), data.draw(st.sampled_from([0.01, 0.2, 0.5, 0.93]))
    assert special.binomial_cdf(k, n, p)[0] == pytest.approx(exact_cdf(k, n, p), rel=1e-9, abs=1e-13)
    assert special.binomial_at_least(k, n, p)[0] == pytest.approx(1 - exact_cdf(k - 1, n, p) if k else 1.0, rel=1e-7, abs=1e-12)


def test_clopper_pearson():
    low, high = special.clopper_pearson([0, 5, 10, 0], [10, 10, 10, 0])
    assert low[0] == 0 and high[2] == 1 and (low[3], high[3]) == (0, 1)
    assert high[0] == pytest.approx(1 - 0.025 ** (1 / 10), rel=1e-9)
    assert low[1] == pytest.approx(0.187086, abs=1e-5) and high[1] == pytest.approx(0.812914, abs=1e-5)


def test_beta_binomial():
    down, up = special.beta_binomial_tails(3, 10, 2.0, 3.0)
    mass = np.exp(special.beta_binomial_log_pmf(np.arange(11), np.full(11, 10), 2.0, 3.0))
    assert mass.sum() == pytest.approx(1) and down + up - mass[3] == pytest.approx(1)
    rng = np.random.default_rng(1)
    p = rng.beta(20, 80, 400)
    k = rng.binomial(500, p)
    a, b = special.fit_beta_binomial(k.astype(float), np.full(400, 500.0))
    assert 12 < a < 32 and a / (a + b) == pytest.approx(k.sum() / (400 * 500))
