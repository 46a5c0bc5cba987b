import numpy as np
from test_multiindex import brute, near

from lorespark.llm import multiindex as X


def test_each_length_is_searched(spark):
    rng, rows = np.random.default_rng(8), []
    for k, d in enumerate((16, 9, 1)):
        v = near(rng, 60, d, 4, 10 - k) if d > 1 else np.array([[2.0], [3.0], [-1.0]])
        rows.append([(1000 * k + i, [float(x) for x in r]) for i, r in enumerate(v)])
    rows[1] += [(1900, rows[1][0][1]), (1901, rows[1][0][1])]
    rows.append([(3000, [1.0, 2.0]), (3001, [1.0, 2.0])])  # one vector and its copy
    df = spark.createDataFrame([r for part in rows for r in part], "vec_id long, embedding array<double>")
    want = sorted(r for part in rows for r in brute(part))
    got = sorted(map(tuple, X.near_duplicates(df).collect()))
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want) and all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want))
    one = {r[0]: r[1:] for r in got}
    assert one[1900][0] >= 2 and one[1900][1] == 1000 and one[3001] == (1, 3000, False) and one[2001] == (1, 2000, False)


def test_an_id_joins_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.1]), (4, [1.0, 0.0, 0.0])]
    got = sorted(map(tuple, X.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
