import numpy as np

from tessera.operators import cells


def test_fit_counts_every_cell():
    x, n = np.log2(np.array([0, 1, 2, 30, 40, 50]) + 1.0), np.array([3_000_000, 400_000, 50_000, 900, 1200, 700])
    w, rate, mean, _ = cells.fit_two(x, n)
    # the share of the upper part and the rate of the lower one follow the cells, however many share a count
    assert abs(w - 2800 / n.sum()) < 1e-4
    assert abs(rate - 0.1393) < 5e-3 and 5 < mean < 5.7
    assert cells._quantile(x, np.array([1, 2, 3, 1, 1, 2]), 0.25) == np.quantile(np.repeat(x, [1, 2, 3, 1, 1, 2]), 0.25)
