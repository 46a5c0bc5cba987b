from collections import Counter

import corpus_pipeline as C
from oracle import sql_rows
from test_simhash import brute, plain
from test_tokens import expected
from test_training_order import by_position

from lorespark.llm import decontaminate as D
from lorespark.llm import mixing as M

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs, kept = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    columns, bench = docs.columns, [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for name, stage in C.STAGES:
        out = C.stored(stage(spark, docs, DIR), name)
        after = [(r.doc_id, r.text, r.source) for r in out.collect()] if name != "token_output" else sorted(map(tuple, out.collect()), key=lambda r: r[1])
        if name == "language_id":
            assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
        if name == "simhash_dedup":
            fp = {i: plain(t) for i, t, _ in before}
            roots = brute(fp.values())
            least = {}
            for i, v in fp.items():
                least[roots[v]] = min(i, least.get(roots[v], i))
            assert sorted(r[0] for r in after) == sorted(least.values()) and set(after) <= set(before)
        if name == "decontaminate":
            names, rows = sql_rows(D.SQL, documents=("doc_id bigint, text varchar", [r[:2] for r in before]), benchmark=("item_id bigint, text varchar", bench))
            bad = {r[names.index("doc_id")] for r in rows if r[names.index("contaminated")]}
            assert sorted(after) == sorted(r for r in before if r[0] not in bad)
        if name == "mix_sources":
            names, rows = sql_rows(M.SQL, documents=("doc_id bigint, text varchar, source varchar", before))
            want = Counter()
            for r in rows:
                r = dict(zip(names, r))
                t1 = min(r["size"], r["taken"])
                times = (2 * t1 >= r["size"] > 0) + (2 * (r["taken"] - t1) >= r["size"] > 0)
                want += Counter({r["doc_id"]: times})
            assert Counter(r[0] for r in after) == want
            in_training_order = by_position(docs)
            assert Counter(i for i, _ in in_training_order) == want
        if name == "token_output":
            assert after == expected(in_training_order)  # the shards follow the curriculum
        else:
            assert out.columns == columns
        docs, before = out, after
    assert sorted(map(tuple, C.run(spark, DIR).collect()), key=lambda r: r[1]) == before


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (None, "some words here", None, "a", 1), (2, "", "de", "a", 2), (3, "x " * 50_000, "en", "a", 3), (3, "x " * 50_000, "en", "a", 3)]
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in C.STAGES:
            stage(spark, df, DIR).collect()
