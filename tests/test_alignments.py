import random

from pyspark.sql import functions as F

from tessera.operators import alignments as A
from tessera.operators.alignments import Piece

rng = random.Random(3)
TARGET = "".join(rng.choice("ACGT") for _ in range(120))
CUT = 59


def test_split_at_indels():
    a = Piece("target", 0, 99, 0, 101, indels=(("D", 50, 5), ("I", 80, 3)))
    parts = A.split_at_indels(a)
    assert [(p.q_start, p.q_end, p.r_start, p.r_end) for p in parts] == [(0, 49, 0, 49), (50, 74, 55, 79), (78, 99, 80, 101)]
    assert A.split_at_indels(a, least=4)[0].q_end == 49 and len(A.split_at_indels(a, least=4)) == 2


def test_parsimonious_and_merge():
    a, b, c = Piece("t", 0, 50, 0, 50), Piece("t", 40, 99, 45, 104), Piece("t", 10, 45, 10, 45)
    assert A.parsimonious([c, b, a]) == [a, b]
    assert A.merge_adjacent([Piece("t", 0, 9, 5, 14), Piece("t", 10, 19, 15, 24), Piece("t", 20, 29, 40, 49)]) == [Piece("t", 0, 19, 5, 24), Piece("t", 20, 29, 40, 49)]


def test_local_alignment():
    assert A.local_alignment("TTACGTT", "GGACGGG") == (15, 2, 4, 2, 4)
    assert A.local_alignment("AAAA", "CCCC")[0] == 0


def test_edges_deletion_and_insertion():
    read = TARGET[:50] + TARGET[70:]
    left, right = A.edge_seed(read, TARGET, True, high=CUT + 1), A.edge_seed(read, TARGET, False, low=CUT + 1)
    gap = A.insertion_with_deletion(left, right, read)
    assert gap["removed"] == 20 and gap["inserted"] == ""
    assert A.edge_seed("NNNN", TARGET, True) is None
    read = TARGET[:55] + "NNN" + TARGET[62:]
    left, right = A.edge_seed(read, TARGET, True), A.edge_seed(read, TARGET, False)
    gap = A.insertion_with_deletion(left, right, read)
    assert gap == {"start": 55, "removed": 7, "inserted": "NNN", "shared": 0}


def test_homology():
    target = "AAACCGTTTTCCGAAA"
    #          012345678901234: CCG before and after the removed part
    assert A.junction_homology(Piece("t", 0, 5, 0, 5), Piece("t", 6, 8, 13, 15), target) == 3


def test_templates_on_both_strands():
    target = "ACGTTGCAAC" + "GATTACAGGC" + "TTTTTTTTTT" + "CCGGAACCTA"
    left, right = Piece("t", 0, 19, 0, 19), Piece("t", 25, 34, 30, 39)
    # C from the left side, the copy, C from the right side
    assert A.templated_by_target("GATTA", left, right, target, 25)["kind"] == "loop-out"
    assert A.templated_by_target("", left, right, target, 25) is None
    assert A.templated_by_target("GGGGGG", left, right, target, 25) is None


def test_donor_and_foreign_kinds():
    donor, edge = Piece("donor", 20, 60, 10, 50), Piece("target", 0, 24, 0, 24)
    assert A.donor_side(donor, edge, ((5, 15),), True) == "intended"
    assert A.donor_side(donor, Piece("target", 0, 19, 0, 19), ((30, 40),), True) == "blunt"
    assert A.donor_side(donor, Piece("target", 0, 9, 0, 9), ((30, 40),), True) == "unintended"
    assert A.donor_side(donor, None, ((5, 15),), True) == "ambiguous"
    primers = ((0, 19), (100, 119))
    assert A.foreign_kind(Piece("hg19", 0, 50, 7, 57), None, None, 100, primers) == "transversion"
    assert A.foreign_kind(Piece("hg19", 25, 80, 7, 62), Piece("target", 0, 24, 0, 24), Piece("target", 81, 105, 95, 119), 106, primers) == "nonspecific amplification"
    assert A.foreign_kind(Piece("hg19", 50, 80, 7, 37), Piece("target", 0, 49, 0, 49), Piece("target", 81, 105, 95, 119), 106, primers) == "genomic insertion"


def test_resolve_reads(spark):
    data = [("a", TARGET[:50] + TARGET[70:]), ("b", TARGET[:50] + TARGET[70:]), ("c", TARGET[:55] + "GGGGGGG" + TARGET[62:]), ("d", None), ("e", ""), ("f", "N" * 50), ("g", TARGET)]
    got = {r.read_id: r for r in A.resolve_reads(spark.createDataFrame(data, "read_id string, seq string"), TARGET, CUT).collect()}
    assert set(got) == {"a", "b", "c", "g"}
    assert got["a"].removed == got["b"].removed == 20 and got["g"].removed == 0
    assert got["c"].removed <= 7 and got["c"].inserted.strip("G") == ""


def test_reads_are_aligned_and_categorised(spark):
    from tessera.operators import categorise as K

    t = TARGET
    dup = t[:60] + t[40:]
    noisy = t[:30] + ("A" if t[30] != "A" else "C") + t[31:]
    reads = {
        "wt": t, "mm": noisy, "del": t[:50] + t[70:], "ins": t[:60] + "GGG" + t[60:], "both": t[:55] + "NNN" + t[62:], "dup": dup, "none": "N" * 90, "far": t[:20] + t[22:], "short": t[:45], "null": None, "empty": "",
    }
    df = spark.createDataFrame([(k, v, "x") for k, v in reads.items()], "name string, seq string, kind string")
    aligned = A.align_reads(df, t, CUT).withColumn("qual", F.rpad(F.lit("F"), F.length("seq"), "F"))
    got = {r["name"]: (r.category, r.details) for r in K.categorise(aligned, K.Target(read_end=119, cut=CUT, primers=())).collect()}
    assert got["wt"] == ("wild type", "n/a") and got["mm"] == ("mismatches", "n/a") and got["dup"] == ("duplication", "simple")
    assert got["none"][0] == got["empty"][0] == got["null"][0] == "bad sequence" and got["short"][0] == "nonspecific amplification"
    assert got["far"] == ("wild type", "n/a")
    left = A.align_read(reads["del"], t, CUT)[0]["indels"][0]
    assert got["del"] == ("deletion", f"D:{left['start']},20") and left["length"] == 20 and left["start"] <= 50
    assert got["ins"][0] == "insertion" and got["ins"][1].endswith(",3")
    assert got["both"] == ("deletion + insertion", "D:55,7;I:55,3")
