import random
import re

import pytest
from oracle import same, sql_rows

from lorespark.llm import decontaminate as D

LONG = " ".join(f"w{i}" for i in range(30))
DOCS = [
    (1, LONG, "x"), (2, "Intro w5 w6, w7 w8 w9 w10 w11 w12 w13 w14 w15 W16 w17 end " + "pad " * 5, "x"), (3, None, "x"), (4, "", "x"), (5, "... !!", "x"),
    (6, "Short item here", "x"), (6, "other row of six, the short ITEM", "x"), (6, "other row of six, the short ITEM", "x"), (None, "the short item", "x"), (7, "É short item é", "x"),
    (8, "a a a a a a a a a a a a a a a a a", "x"), (9, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 " + "z " * 400, "x"), (10, LONG + " y" * 1000 + " " + LONG, "x"),
]
ITEMS = [(1, LONG), (2, "short item"), (3, None), (4, "!!"), (5, "a " * 14), (10, "SHORT, item"), (2, "short item")]


@pytest.mark.parametrize("block", [50_000, 3])
def test_cases(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    # the SQL joins by doc_id, so rows that share one or have none are compared by hand
    single = [r for r in DOCS if r[0] not in (None, 6)]
    names, rows = sql_rows(D.SQL, documents=("doc_id bigint, text varchar, items varchar", single), benchmark=("item_id bigint, text varchar", ITEMS))
    same(D.contamination(docs.filter("doc_id <> 6"), items).drop("text_hash"), names, rows)
    got = sorted((r.n_words, r.n_hit, r.n_items) for r in D.contamination(docs.filter("doc_id = 6 or doc_id is null"), items).collect())
    assert got == [(3, 2, 2), (3, 2, 2), (7, 2, 2), (7, 2, 2)]


def test_empty_sides(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in D.contamination(docs, items.limit(0)).collect()] == [0] * len(DOCS)
    assert D.contamination(docs, items.filter("item_id = 1")).filter("n_hit > 0").count() == 3  # shingles of three words


def test_query(spark):
    same(D.op6_decontaminate(spark, "/root/testdata/sf0.01"), *sql_rows(D.SQL, "/root/testdata/sf0.01"))


def plain(docs, items):
    """n_words, n_hit and names by trying every window at every place."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    out = []
    for _, t in docs:
        ws, hit, names = split(t), set(), set()
        for item, it in items:
            v = split(it)
            n = min(len(v), 13)
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for at in range(len(ws)):
                if tuple(ws[at : at + n]) in wins and n:
                    hit |= set(range(at, at + n))
                    names |= {str(item)} - {"None"}
        out.append((len(ws), len(hit), len(names)))
    return sorted(out)


@pytest.mark.parametrize("block", [50_000, 2])
def test_items_of_all_lengths_against_every_place(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i if i % 5 else None, some(rng.randrange(60)) + " z" * (i % 3) + " " + some(40)) for i in range(30)] + [(99, "q")]
    items = [(1, "z"), (2, "z z"), (3, "a b c"), (None, docs[3][1][:30]), (5, docs[7][1][:40]), (6, docs[8][1][4:28]), (7, "never seen here"), (8, some(13)), (9, "q q")]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.n_words, r.n_hit, r.n_items) for r in got.collect()) == plain(docs, items)


def test_shingles_that_share_a_hash_take_another_salt(spark, monkeypatch):
    real = D._shingle
    monkeypatch.setattr(D, "_shingle", lambda ws, at, q, salt: real(ws, at, q, salt) % 2 if salt == 0 else real(ws, at, q, salt))
    docs = spark.createDataFrame([(1, "x a b c d e y"), (2, "a b c d x e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert D.benchmark_shingles(items)[3] == 1
    assert sorted((r.doc_id, r.n_hit) for r in D.contamination(docs, items).collect()) == [(1, 5), (2, 0)]
