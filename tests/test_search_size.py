"""Search on tables of any size: what is dealt, how finely, and that pruning by heading hits loses nothing."""

import random
import re
from collections import Counter
from math import log

from lorespark.functions import text as T
from lorespark.operators import search
from lorespark.plans import catalog as C
from pyspark.sql import functions as F

SCHEMA = "chunk_sk long, title string, heading string, text string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()



def made(n, seed=1):
    r, words = random.Random(seed), [f"w{i}" for i in range(30)]
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    return [(i, some(r.randint(0, 3)), some(r.randint(0, 2)), some(r.randint(0, 12))) for i in range(n)], [(i, some(r.randint(1, 9))) for i in range(12)] + [(90, "x1 x2"), (91, "")]


def brute(chunks, questions, k, least, title_boost=0.45):
    words = lambda x: re.findall(r"[a-z0-9_+\-]+", x.lower())
    bodies = {c[0]: Counter(words(c[3])) for c in chunks}
    df, n = Counter(t for b in bodies.values() for t in b), len(chunks)
    avg = sum(sum(b.values()) for b in bodies.values()) / n
    out = []
    for q, text in questions:
        asked, rows = set(words(text)), []
        for sk, title, heading, _ in chunks:
            body, dl = bodies[sk], sum(bodies[sk].values())
            base = sum(log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * body[t] * 2.5 / (body[t] + 1.5 * (0.25 + 0.75 * max(dl, 1) / max(avg, 1))) for t in asked if t in body)
            hits, long = sum(len(t) >= 3 for t in asked if t in body), any(len(t) >= 3 for t in asked)
            hh, part = len(asked & set(words(f"{heading} {title}"))), any(len(t) > 1 and t in title for t in asked)
            if hh or part or any(t in body for t in asked):
                score = round((base if not long else base * 0.35 if not hits else base + 0.75 * hits) + 0.9 * hh + title_boost * part, 6)
                rows += [(-hh, -score, sk)] if score >= least else []
        out += [(q, sk, -hh, rank) for rank, (hh, _, sk) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def test_no_chunk_is_lost_by_heading_hits(spark):
    chunks, questions = made(300)
    index, asked = search.build_index(spark.createDataFrame(chunks, SCHEMA)), spark.createDataFrame(questions, "query_id long, text string")
    for k, least, title in ((1, 0.1, 0.45), (4, 0.1, 0.45), (4, 4.0, 0.45), (3, 0.95, 5.0)):
        got = search.search(index, asked, k=k, min_score=least, title_boost=title).collect()
        assert sorted((r.query_id, r.chunk_sk, r.heading_hits, r["rank"]) for r in got) == brute(chunks, questions, k, least, title), (k, least, title)


def test_matches_are_dealt_once(spark):
    chunks, questions = made(50)
    df = search.search(search.build_index(spark.createDataFrame(chunks, SCHEMA)), spark.createDataFrame(questions, "query_id long, text string"))
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(chunk_sk#[^\n]*", re.sub(r"ReusedExchange[^\n]*", "", final))) == 1


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PARTITION", 20_000, raising=False)
    chunks, questions = made(50)
    spark.createDataFrame(chunks, SCHEMA).write.parquet(f"{tmp_path}/chunks")
    df = search.search(search.build_index(spark.read.parquet(f"{tmp_path}/chunks")), spark.createDataFrame(questions, "query_id long, text string"))
    assert max(int(n) for n in re.findall(r"hashpartitioning\(chunk_sk#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(df)) or [0]) > 8


def test_large_files_are_dealt_in_bounded_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "TASK", 100, raising=False)
    spark.range(400).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source")).repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.texts(spark, str(tmp_path)).rdd.getNumPartitions() > 32


def test_texts_that_were_found_are_not_dealt_again(spark):
    for name in ("source_projection", "sources_over_chunks"):
        assert not re.search(r"SortMergeJoin \[(chunk_sk|doc_id)", plan(C.QUERIES[name](spark, "/root/testdata/sf0.001"))), name


def test_runs_of_tokens(spark):
    cases = [["b", "a", "b"], [], ["x"], ["a"] * 5 + ["b"]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ts array<string>").orderBy("i").select(F.expr(search.counted("ts"))).collect()
    assert [{x.token: x.tf for x in r[0]} for r in rows] == [dict(Counter(c)) for c in cases]
    assert spark.range(1).select(F.expr(T.let("ts", "array('q', 'q')", search.counted("ts")))).first()[0][0].tf == 2
