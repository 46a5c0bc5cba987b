import numpy as np
import pytest
import xxhash

from lorespark.llm import simhash as S


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute(values):
    """Component minimum of each fingerprint, by all pairs."""
    vs = sorted(set(values))
    root = {v: v for v in vs}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(vs):
        for b in vs[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    return {v: find(v) for v in vs}


def test_fingerprint_matches_its_definition():
    for t in ["", None, " \t\n", "One", "One two", "A b C d e f", "É x É  y\x0bz \x1c q", "ß " * 70]:
        assert int.from_bytes(S.fingerprint(t), "big") == plain(t)


@pytest.mark.parametrize("group", [4096, 8])
def test_components_match_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    vals = list(base)
    for b in base[:6]:
        for _ in range(60):
            v = b
            for i in rng.integers(0, 64, rng.integers(1, 6)):
                v ^= 1 << int(i)
            vals.append(v)
    vals += [base[0] ^ 7 << (8 * i) for i in range(8)] + [0, 0, 1, 7, 15, (1 << 64) - 1]
    df = spark.createDataFrame([(S.signed(v),) for v in vals], "fp long")
    heads = {r.node: r.root for r in S.components(S.links(df)).collect()}
    got = {}
    for v in set(vals):
        got.setdefault(heads.get(S.signed(v), S.signed(v)), set()).add(v)
    want = {}
    for v, r in brute(vals).items():
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, "a b c d", 1), (3, "A  b\tc\nd", 2), (5, "a b c d", 1), (7, None, 1), (8, "", 1), (None, "zz", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id or -1), r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect())
    f = f"{plain('a b c d'):016x}"
    assert got == sorted([(5, f, 3), (3, f, 3), (5, f, 3), (7, "0" * 16, 7), (8, "0" * 16, 7), (-1, f"{plain('zz'):016x}", None)])
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: plain(r.text) for r in docs}
    roots = brute(fp.values())
    least = {}
    for i, v in fp.items():
        least[roots[v]] = min(i, least.get(roots[v], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op2_simhash_dedup(spark, d).collect()}
    assert got == {i: (f"{v:016x}", least[roots[v]]) for i, v in fp.items()}


def test_long_texts_and_tallies():
    words = [f"w{i * 7919 % 1009}" for i in range(70_000)]  # more than 32,768 shingles, so counts are added in parts
    assert S.fingerprint(" ".join(words)).hex() == f"{plain(' '.join(words)):016x}"
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for bits in range(6):
        b = a.copy()
        for i in range(len(b)):
            for k in rng.choice(64, bits, replace=False):
                b[i] ^= np.uint64(1 << int(k))
        assert S._linking(a ^ b).all() == (bits <= 3) and S._linking(a ^ b).any() == (bits <= 3)
