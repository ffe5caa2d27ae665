import numpy as np
from pyspark.sql import functions as F

from tessera.operators import statistics as S


def test_sizes_and_draws_of_the_reference():
    assert len(S.NULL_CELLS) == 95 and (min(S.NULL_CELLS), max(S.NULL_CELLS), S.NULL_SAMPLES) == (10, 35000, 100_000)


def test_nulls_over_sizes(spark):
    data = [(f"g{i % 4}", f"o{i % 3}", "deletion" if i % 3 else None) for i in range(240)]
    df = spark.createDataFrame(data, 'guide string, outcome string, `group` string')
    cells, samples = [10, 100, 500], 1000
    f = S.null_frequencies(df, cells, samples, chunk=300).cache()
    # a size beyond all records is reached as guides come again; every draw has its size
    whole = {r.cells: r.s for r in f.filter(F.col("outcome").startswith("o")).groupBy("cells").agg(F.sum(F.col("n") * F.col("f")).alias("s")).collect()}
    assert whole == {c: c * samples for c in cells}
    got = {(r.cells, r.outcome): r for r in S.null_grid_quantiles(f, cells, samples).collect()}
    assert all(got[c, "not_observed"].up_3 == 1 and (c, "insertion") in got for c in cells)
    for (c, o), r in got.items():
        draws = [0] * samples if o in ("not_observed", "insertion", "partial_donor") else None
        if draws is None:
            seen = [n for x in f.filter((F.col("cells") == c) & (F.col("outcome") == o)).collect() for n in [x.n] * x.f]
            draws = seen + [0] * (samples - len(seen))
        leq = np.cumsum(np.bincount(draws, minlength=c + 1))
        geq = samples - leq + np.bincount(draws, minlength=c + 1)
        assert r.median == np.searchsorted(leq, samples * 0.5) and r.down_2 == np.searchsorted(leq, samples // 100)
        assert r.up_2 == next((n for n in range(c + 1) if geq[n] < samples // 100), c + 1)
    assert abs(got[100, "deletion"].median - 67) <= 2
