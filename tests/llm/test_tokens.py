import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lorespark.llm import tokens as T
from lorespark.llm import wavelet as W

ODD = ["", "a", "  two  spaces ", "x\n y", " \n z", "tab\t\there", "don't we'll '", "<|endoftext|> a<|endoftext|>b", "\x1cq\x1d r", "é ñ Übergröße", "漢字 テスト", " em  nbsp \x85 nel", "12 345 6.7", "a" * 5000, "ẞΣς ΑΣ İ", "é ́x", "Ᲊ \U0001F916 ​﻿", "AKIA9 +1 (98) 5-5 a@b.c"]


def texts(spark):
    return ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]


def test_counts_are_the_librarys(spark):
    t, count = Tokenizer.from_file(P.path("byte_bpe_50k.json")), T.counter(T.VOCABULARY)
    for x in texts(spark):
        assert count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x[:80])
    for c in [*range(1, 0x3000), *range(0xFE00, 0x10000)]:
        if not 0xD800 <= c < 0xE000:
            x = f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1 c{chr(c)}"
            assert count(x) == len(t.encode(x, add_special_tokens=False).ids), hex(c)


def test_whole_tokens_are_proven():
    t, whole = Tokenizer.from_file(P.path("byte_bpe_50k.json")), T.whole_tokens(T.VOCABULARY)
    assert len(whole) > 40_000 and all(len(t.encode(s).ids) == 1 for s in sorted(whole)[::50])


def test_ids_are_the_librarys(spark):
    t, encode = Tokenizer.from_file(P.path("word_bpe_49k.json")), W.encoder(W.VOCABULARY)
    rows = texts(spark) + [None] + [f"A{chr(c)}b {chr(c)} {chr(c)}'s" for c in range(1, 0x3100)]
    for part in (rows, rows[3:9], rows[:0]):  # a batch's texts share their stretches
        ids, sizes = encode(pa.array(part, type=pa.string()).slice(1))
        ends = np.cumsum(sizes)
        assert len(sizes) == max(0, len(part) - 1) and len(ids) == sum(sizes)
        for x, a, z in zip(part[1:], ends - sizes, ends):
            assert ids[a:z].tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x[:80])


def test_caches_keep_no_long_strings():
    made = []
    c = T.Cache(lambda s: made.append(s) or len(s), size=10)
    assert [c["a" * 65], c["a" * 65], c["b"], c["b"]] == [65, 65, 1, 1] and len(made) == 3 and list(c) == ["b"]
    for i in range(100):
        c[str(i)]
    assert len(c) <= 10 and len(c.old) <= 10


@pytest.mark.parametrize("n,top", [(0, 5), (1, 0), (7, 1), (3000, 49407), (1025, 70000), (512, 3)])
def test_wavelet_matrix_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top + 1, n).astype(np.uint32)
    s = W.Shard(W.build(ids, np.array([0, n // 2, n])))
    assert (s.decode() == ids).all() and s.starts.tolist() == [0, n // 2, n]
    for i in rng.integers(0, max(n, 1), 20)[: n and 20]:
        token = int(ids[i])
        where = np.flatnonzero(ids == token)
        assert s.access(int(i)) == token and s.count(token) == len(where) and s.rank(token, int(i)) == (where < i).sum()
        assert s.select(token, len(where) - 1) == where[-1]
    if n:
        assert list(s.occurrences(int(ids[0])))[:3] == np.flatnonzero(ids == ids[0])[:3].tolist()
    assert s.count(1 << 20) == 0
    with pytest.raises(IndexError):
        s.select(1 << 20, 0)


def expected(rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, at = [], 0
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_5_and_8(spark):
    d = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, W.op5_wavelet_tokens(spark, d).collect())) == expected(rows)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [(i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for i, x in rows]
    assert sorted(map(tuple, T.op8_token_counts(spark, d).collect())) == want


def test_nulls_repeats_small_shards(spark, tmp_path):
    df = spark.createDataFrame([(2, "b c", 1), (2, "b c", 1), (1, None, 1), (None, "z", 1), (3, "", 1)], "doc_id long, text string, start int")
    m = W.write_shards(df, str(tmp_path / "s"), shard=2)
    got = sorted(map(tuple, W.read_shards(m, str(tmp_path / "s")).collect()), key=lambda r: r[1])
    assert got == expected([(None, "z"), (1, None), (2, "b c"), (2, "b c"), (3, "")])
    assert W.token_output(df.limit(0)).count() == 0 and T.token_counts(df.limit(0)).count() == 0
    assert sorted(map(tuple, T.token_counts(df).collect()), key=str) == sorted([(2, 3, 2, False), (2, 3, 2, False), (1, 0, 0, False), (None, 1, 1, False), (3, 0, 0, False)], key=str)


def test_files_alone_tell_ids_and_counts(spark, tmp_path):
    rows = [(i * 37 % 101, f"text {i} " * (i % 9)) for i in range(101)]
    at = tmp_path / "s"
    m = W.write_shards(spark.createDataFrame(rows, "doc_id string, text string").repartition(5), str(at), shard=50)
    got, before = [], 0
    for f in sorted(at.glob("*.lswm")):  # names ascend as documents do
        s = W.Shard(f.read_bytes())
        got += [(i, before + int(a), int(z - a)) for i, a, z in zip(s.ids, s.starts[:-1], s.starts[1:])]
        before += s.n
    want = [x[:3] for x in expected(sorted((str(i), t) for i, t in rows))]
    assert got == want and len(list(at.glob("*.lswm"))) > 5
    read = W.read_shards(m, str(at), "string")
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in read.collect()) == [(b, a, c) for a, b, c in want]


def test_a_task_that_runs_again_writes_the_same_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(3)
    at = tmp_path / "s"
    m = W.write_shards(df, str(at), shard=20)
    was = {f.name: f.read_bytes() for f in at.iterdir()}
    W.write_shards(df, str(at), shard=20)  # onto what is there
    assert {f.name: f.read_bytes() for f in at.iterdir()} == was
    assert sorted(map(tuple, W.read_shards(m, str(at)).collect()), key=lambda r: r[1]) == expected([(i, f"text {i}") for i in range(40)])
