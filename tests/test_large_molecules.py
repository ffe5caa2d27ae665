import random

from tessera.operators import umi


def _reads(n=260, seed=5):
    rng = random.Random(seed)
    true = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(5)]
    out = []
    for i in range(n):
        seq = list(rng.choice(true) if i % 7 else "".join(rng.choice("ACGT") for _ in range(20)))
        qual = ["I"] * 20
        for at in rng.sample(range(20), 3):
            qual[at] = rng.choice("#/5")
            seq[at] = rng.choice("ACGT")
        out.append(("hot" if i % 4 else f"u{i % 3}", i, "".join(seq), "".join(qual)))
    # no sequence occurs twice: the consensus of all is the seed
    far = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(30)]
    return out + [("single", n + i, s, "#" * 20) for i, s in enumerate(dict.fromkeys(far))]


def test_large_molecule_as_in_one_task(spark):
    df = spark.createDataFrame(_reads(), "umi string, id long, seq string, qual string")
    collect = lambda size: sorted(map(tuple, umi.collapse_reads(df, ["umi"], "id", "seq", "qual", group_reads=size).collect()))
    assert collect(25) == collect(10_000)
