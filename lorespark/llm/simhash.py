"""SimHash near-dedup with a byte-position inverted index and count filtering.

A document's fingerprint has 64 bits: bit i is 1 if it is 1 in over half of the XXH64 values (seed 42) of its
three-word shingles, repeats included. Two fingerprints link at MAX_BITS = 3 or fewer differing bits.

Three differing bits touch three of the eight bytes at most, so linked fingerprints agree in five byte
positions at least: five is the guaranteed minimum of the count filter. A posting list of one (position, byte)
would hold a 256th of all rows, so the index is kept on what the tally has to reach: each of the 56 sets of
five positions with their bytes is one posting, where every pair that can reach the minimum meets. In a posting the
bytes that a pair shares by position are tallied, pairs with a tally under LEAST = 5 are dropped, and the pairs that
are left are verified by their differing bits.

Groups of near copies make long postings. A posting of up to GROUP distinct fingerprints is compared in blocks
inside one task, and only a star of each linked class leaves it (never all pairs). A longer posting is split
with the same filter on half bytes: its fingerprints differ in six half bytes, three of which must agree, so
each of 20 finer postings fixes 52 bits and cannot have more than 4096 members. Nothing is capped.

Cases: text null, empty or without words gives fingerprint zero, which links like any other. Rows that repeat
a doc_id are separate rows of one id. A null doc_id is returned with its component (null if no member has an
id). An empty table gives an empty result. Other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import bounded_batches, components, stored

MAX_BITS, GROUP, SEED, SHINGLE = 3, 4096, 42, 3
#: Bytes that fingerprints with MAX_BITS differing bits share at least.
LEAST = 8 - MAX_BITS
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: Masks of five of eight bytes; and for each, masks that add three of the six half bytes it leaves.
BYTES = [sum(0xFF << 8 * i for i in c) for c in combinations(range(8), 8 - MAX_BITS)]
HALVES = [
    [m | sum(0xF << 4 * i for i in c) for c in combinations([i for i in range(16) if not m >> 4 * i & 0xF], 3)] for m in BYTES
]


def fingerprint(text: str | None) -> bytes:
    """Eight bytes, the highest bit first."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return bytes(8)
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(raw), 1 << 15):
        ones += np.unpackbits(raw[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(raw)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join([fingerprint(t.as_py()) for t in b.column(1)])
            fp = np.frombuffer(raw, dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _linking(x: np.ndarray) -> np.ndarray:
    """Of the differences (XOR) of pairs: whether the tally of shared bytes reaches the minimum, and then whether the
    pair is verified by its bits."""
    retained = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1, dtype=np.uint8) >= LEAST
    retained[retained] = np.bitwise_count(x[retained]) <= MAX_BITS
    return retained


def _classes(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars of the linked classes of distinct fingerprints: arrays of (member, centre)."""
    n = len(fp)
    near = np.empty((n, n), dtype=bool)
    for i in range(0, n, 256):
        near[i : i + 256] = _linking(fp[i : i + 256, None] ^ fp[None, :])
    left = np.ones(n, dtype=bool)
    for i in range(n):
        if left[i]:
            seen, front = np.zeros(n, dtype=bool), np.array([i])
            seen[i] = True
            while len(front):
                new = near[front].any(axis=0) & ~seen
                seen |= new
                front = np.flatnonzero(new)
            left &= ~seen
            members = np.flatnonzero(seen)
            if len(members) > 1:
                yield fp[members[1:]], np.full(len(members) - 1, fp[members[0]])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, k, fp) in order of (c, k, fp): stars (-1, a, b) of the classes of each posting, and the rows
    (c, fp, fp) of postings with more than GROUP distinct fingerprints, which are to be split."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows, large = 0, None

    def out(c, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), c, dtype=np.int32)), pa.array(a), pa.array(b)], names=["c", "a", "b"])

    def closed(c: np.ndarray, k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
        begin, end = np.r_[0, cut], np.r_[cut, len(c)]
        pairs = begin[end - begin == 2]
        if len(pairs):
            a, b = fp[pairs], fp[pairs + 1]
            ok = _linking((a ^ b).view(np.uint64))
            if ok.any():
                yield out(-1, a[ok], b[ok])
        for s, e in zip(begin[end - begin > 2], end[end - begin > 2]):
            for a, b in _classes(fp[s:e].view(np.uint64)):
                yield out(-1, a.view(np.int64), b.view(np.int64))

    for batch in batches:
        c, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if large is not None:
            same = (c == large[0]) & (k == large[1])
            if same.any():
                yield out(large[0], fp[same], fp[same])
                c, k, fp = c[~same], k[~same], fp[~same]
            if len(c):
                large = None
        if not len(c):
            continue
        held.append((c, k, fp))
        c, k, fp = (np.concatenate(x) for x in zip(*held))
        last = int(np.flatnonzero((c != c[-1]) | (k != k[-1])).max(initial=-1)) + 1
        if last:
            yield from closed(c[:last], k[:last], fp[:last])
        c, k, fp = c[last:], k[last:], fp[last:]
        if len(c) > GROUP:
            large = (c[0], k[0])
            yield out(c[0], fp, fp)
            held = []
        else:
            held = [(c, k, fp)]
    if held:
        yield from closed(*held[0])


def _postings(rows: DataFrame, masks: Column) -> DataFrame:
    """rows (c, fp) and the masks of each: stars and rest of all postings."""
    spread = rows.select("fp", "c", F.explode(masks).alias("m"))
    keyed = spread.select(F.col("m.c").alias("c"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("k"), "fp")
    return keyed.repartition("c", "k").sortWithinPartitions("c", "k", "fp").mapInArrow(_linked, "c int, a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join the same classes as all pairs of
    MAX_BITS or fewer differing bits do."""
    bounded_batches(fps.sparkSession)
    entry = lambda c, m: F.struct(F.lit(c).cast("int").alias("c"), F.lit(signed(m)).cast("long").alias("mask"))
    # dealt to all tasks before each row becomes 56: by size they would be put together in a few
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.select("fp").distinct().repartition(tasks, "fp").withColumn("c", F.lit(0))
    first = stored(_postings(rows, F.array(*[entry(i, m) for i, m in enumerate(BYTES)])), "postings")
    rest = first.filter("c >= 0").select(F.col("a").alias("fp"), "c")
    finer = F.array(*[F.array(*[entry(20 * i + j, m) for j, m in enumerate(ms)]) for i, ms in enumerate(HALVES)])
    again = _postings(rest, F.element_at(finer, F.col("c") + 1))
    return first.filter("c < 0").select("a", "b").union(again.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): component_id is the smallest id reachable over links, itself included."""
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    heads = components(links(fps), "simhash")
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = least.join(heads, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id (a null id only where there is no
    other), of rows with that id the one with the smallest text hash, and of equal rows one."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    marked = docs.withColumn("__name", name).withColumn("__hash", F.xxhash64(text_col))
    rows = marked.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__name").alias("name"), F.col("__hash").alias("hash")).alias("r"), F.col(text_col).alias("t"))
    fps = stored(fingerprints(rows, "r", "t"), "fingerprints")
    heads = components(links(fps), "simhash")
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = least.join(heads, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("least"))
    keep = rooted.select(F.col("least.name").alias("__name"), F.col("least.hash").alias("__hash"))
    return marked.join(keep, ["__name", "__hash"], "left_semi").dropDuplicates(["__name", "__hash"]).select(*docs.columns)


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    from lorespark.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
