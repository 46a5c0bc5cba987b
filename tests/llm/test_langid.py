import math
import zlib

import numpy as np

from lorespark.llm import langid as L


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = L.op3_language_id(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    right = [r.lang_pred == truth[r.doc_id][0] for r in held]
    print("held-out accuracy", sum(right) / len(right), "rejected", sum(r.rejected for r in got), [(r.doc_id, r.score, truth[r.doc_id][1][:60]) for r in got if r.rejected][:5])
    print([(r.lang_pred, truth[r.doc_id][0], round(r.score, 2), truth[r.doc_id][1][:80]) for r in held if r.lang_pred != truth[r.doc_id][0]])
    assert sum(right) / len(right) >= 0.97 and sum(r.rejected for r in got) <= 0.01 * len(got)
    again = {r.doc_id: (r.lang_pred, r.score) for r in L.op3_language_id(spark, d).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_cases(spark):
    rows = [(1, "the cat and the dog " * 20, "en"), (3, "le chat et le chien " * 20, "fr"), (4, None, "en"), (5, "12 !? ", "en"), (6, "", None), (7, "x" * 300_000, None), (None, "the end", None), (1, "the cat and the dog " * 20, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.train(df, ~L.held_out())
    got = {(r.id, r.lang_pred) for r in L.identify(df, m).collect()}
    assert {(4, "und"), (5, "und"), (6, "und")} <= got and all(p in ("en", "fr", "und") for _, p in got) and L.identify(df, m).count() == len(rows)
    assert L.identify(df.limit(0), m).count() == 0 and L.filtered(df.filter("doc_id in (4, 5, 6)"), m).count() == 0
    assert L.filtered(df, m).columns == df.columns
    none = L.train(df.filter("lang is null"), ~L.held_out())
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    one = L.train(df.filter("lang = 'fr'"), ~L.held_out())
    assert {r.lang_pred for r in L.identify(df, one).collect()} == {"fr", "und"}


def test_pieces_do_not_change_counts(monkeypatch):
    text = "Ünd so weiter, und so fort. " * 50
    whole = L.counts(text)
    monkeypatch.setattr(L, "PIECE", 64)
    assert (L.counts(text) == whole).all()


def plain_counts(text):
    """Gram by gram: subwords of 2 to 4 bytes of words with their edges."""
    out = [0] * L.BUCKETS
    for w in text.lower().encode("utf-8", "surrogatepass").translate(L.TABLE).split():
        w = b" " + w + b" "
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                h = w[i]
                for k in range(2, n + 1):
                    h = (h * 0x9E3779B1 & 0xFFFFFFFF) ^ (w[i + k - 1] * (0x85EBCA77 + 2 * k) & 0xFFFFFFFF)
                    h ^= h >> 15
                out[h & L.BUCKETS - 1] += 1
    return out


def test_predictions_are_those_of_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = L.train(docs, ~L.held_out())
    got = {r.id: (r.lang_pred, r.score) for r in L.identify(docs, m).collect()}
    for r in docs.collect():
        if len(r.text or "") > 6000:
            continue
        c = plain_counts(r.text or "")
        total, z = max(1, sum(c)), list(m.bias)
        for b, n in enumerate(c):
            for k in range(len(z)) if n else ():
                z[k] += float(m.table[b][k]) * n / total
        z = [v / m.temperature for v in z]
        e = [math.exp(v - max(z)) for v in z]
        best = max(range(len(m.langs)), key=lambda k: e[k])
        if any(x.isalpha() for x in r.text or ""):
            assert got[r.doc_id][0] == m.langs[best] and abs(got[r.doc_id][1] - e[best] / sum(e)) < 1e-4


def test_noise_and_other_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = L.train(docs, ~L.held_out())
    assert 0.2 < m.temperature < 5 and 0 < m.threshold < 0.6
    rng = np.random.default_rng(3)
    texts = [r.text for r in docs.filter("length(text) > 300").orderBy("doc_id").limit(60).collect()]
    strange = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)) for _ in range(40)]
    strange += ["Witaj świecie, jestem bardzo szczęśliwy że mogę tu być z wami", "Het is een mooie dag om naar het strand te gaan met vrienden"]
    assert sum(m.predict(x)[1] < m.threshold for x in strange) >= 0.9 * len(strange)
    assert all(m.predict(x)[1] >= m.threshold for x in texts)
    assert L.filtered(docs, m).count() >= 0.995 * docs.filter("text is not null").count()


def test_copies_teach_once_and_names_may_clash(spark):
    rows = [(None, f"the cat {i % 3} and the dog " * 5, "en", "k", "x") for i in range(50)] + [(i, f"le chat {i % 4} et le chien " * 5, "fr", "t", "y") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, k string, t string")
    a, b = L.train(df, L.F.lit(True)), L.train(df.repartition(7), L.F.lit(True))
    assert (a.table == b.table).all() and a.threshold == b.threshold and a.langs == ["en", "fr"]
    assert L.identify(df, a).count() == 100 and set(L.filtered(df, a).columns) == set(df.columns)
