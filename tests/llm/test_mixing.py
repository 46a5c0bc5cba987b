from collections import defaultdict

import pytest
from oracle import same, sql_rows

from lorespark.llm import mixing as M
from pyspark.sql import functions as F


def planned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    return M.mixed(df.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("src"), M.size_of(F.col("text")).alias("size")))


def fill(sizes):
    """Targets by the rule itself: share, stop, share again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    got, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while free and left > 1e-9:
        unit = left / sum(w[s] for s in free)
        for s in free:
            got[s] += unit * w[s]
        left = 0.0
        for s in [s for s in free if got[s] >= 2 * sizes[s]]:
            left += got[s] - 2 * sizes[s]
            got[s] = 2.0 * sizes[s]
            free.discard(s)
    return got


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, None: 100, "": 7}, {"a": 5}, {"a": 0, "b": 9, "c": 40, "d": 4, "é": 300}, {None: 3, "z": 3}, {"a": 0}])
def test_targets_and_taken(spark, sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for k in range(7):
            m = n // 7 + (k < n % 7)
            rows.append((i, " w" * m if m else (None if k % 2 else ""), s, 1))
            i += k != 3  # some ids repeat
    out = planned(spark, rows).collect()
    want = fill(sizes)
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"] and abs(r.target - want[r.row.source]) < 1e-6 and r.total == sizes[r.row.source]
        taken[r.row.source] += r.taken
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, "abc"[i % 3], 1) for i in range(600)]
    out = planned(spark, rows).collect()
    for s, ramp in zip("abc", M.RAMPS):
        mine = [r for r in out if r.row.source == s]
        for t in (0.25, 0.5, 0.75, 1.0):
            got = sum(x for r in mine for x, p in ((r.taken_1, r.position_1), (r.taken_2, r.position_2)) if p < t)
            assert abs(got - mine[0].target * ((1 - ramp) * t + ramp * t * t)) <= 11


def test_curriculum_keeps_columns_and_order(spark):
    df = spark.createDataFrame([(i, "w " * (i % 5), "ab"[i % 2], i) for i in range(40)], "doc_id long, text string, source string, size int")
    out = M.curriculum(df)
    assert out.columns == df.columns and out.filter("size(split(text, ' ')) < 2").count() == 0
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in M.curriculum(df).collect())
    assert M.curriculum(df.limit(0)).count() == 0


def test_query(spark):
    same(M.op10_mix_sources(spark, "/root/testdata/sf0.01"), *sql_rows(M.SQL, "/root/testdata/sf0.01"))
