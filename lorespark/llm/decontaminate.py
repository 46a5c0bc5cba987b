"""Benchmark decontamination by a prefix-filtered set join of shingles.

Words are the runs of characters outside \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F after A-Z are lower-cased. An item's
windows are its runs of WINDOW = 13 words; a shorter item that has words is one window. A document word inside
any occurrence of a window is hit.

A window occurs only where all its shingles do, so a prefix of one shingle is necessary; the rarest of the
window, by its count over all documents, gives the fewest candidates. Texts are split once: the places where
a shingle of the benchmark stands are kept as a table, and everything else follows from it. A shingle is told by its
hash, and its words are compared where it is found; the benchmark's own shingles have different hashes, or another
salt is taken. Places meet prefix tokens; the shingle's offset and the window's length bound where the window would
lie in the document (positional and length filter), and in the documents that are left the window's shingles are
compared with those that stand in a row there, which is exact. A window of which some shingle occurs nowhere needs no
join. Shingles have SHINGLE = 3 words; only items of fewer have shorter ones, of their own length.

The benchmark side is broadcast in blocks of at most BLOCK windows or their shingles, however large it is. Only
built-in expressions run on the executors.

Cases: null, empty or wordless texts have no words, no hits and aren't contaminated; such items have no window.
Rows that repeat a doc_id with another text are judged alone; equal rows are returned equally often. Items that
repeat an id count once. A null item_id isn't listed. Empty documents give an empty result, an empty benchmark no
hits. Other columns are passed over."""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import stored, table

WINDOW, SHINGLE, BLOCK = 13, 3, 50_000
#: Fixed value: what lies between words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATOR, -1), "")


def _shingle(ws: Column, at: Column, q: int, salt: int) -> Column:
    """Hash of q words from position at (from 0); null where they don't all exist."""
    return F.when(at + q <= F.size(ws), F.xxhash64(F.lit(salt), F.lit(q), *[F.get(ws, at + i) for i in range(q)]))


def _plain(ws: Column, at: Column, q: int) -> Column:
    """The q words from position at (from 0). Words hold no spaces."""
    return F.concat_ws(" ", *[F.get(ws, at + i) for i in range(q)])


def _blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """df in parts of about most rows, each small enough to broadcast."""
    k = max(1, math.ceil(df.count() / most))
    return [F.broadcast(df.filter(F.pmod(F.xxhash64(key), F.lit(k)) == i)) for i in range(k)]


def _key(id: Column) -> Column:
    """An id as a string that isn't null."""
    return F.concat(F.when(id.isNull(), "n").otherwise("i"), F.coalesce(id.cast("string"), F.lit("")))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, n, items): each distinct window, its number of words, and the ids of its items as strings."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    n = F.least(F.size("w"), F.lit(WINDOW))
    each = rows.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return each.select("item", F.slice("w", F.col("i"), F.col("n")).alias("win"), "n").groupBy("win", "n").agg(F.collect_set("item").alias("items"))


def benchmark_shingles(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int], int]:
    """Of a benchmark: windows (ss, n, q, items) with the hashes ss of their shingles of q words, distinct shingles
    (s, plain), the lengths q that occur, and the salt under which no two shingles share a hash."""
    wins = stored(windows(items).withColumn("q", F.least("n", F.lit(SHINGLE))), "windows")
    qs = sorted(r[0] for r in wins.select("q").distinct().collect())  # SHINGLE at most
    for salt in range(1 << 30):
        parts = []
        for q in qs:
            at = F.sequence(F.lit(0), F.col("n") - q)
            of = lambda f: F.transform(at, f)
            parts.append(wins.filter(F.col("q") == q).select("n", "q", "items", of(lambda i: _shingle(F.col("win"), i, q, salt)).alias("ss"), of(lambda i: _plain(F.col("win"), i, q)).alias("plains")))  # noqa: B023
        hashed = stored(reduce(DataFrame.union, parts or [wins.select("n", "q", "items", F.array().cast("array<bigint>").alias("ss"), F.array().cast("array<string>").alias("plains"))]), "hashed")
        mark = hashed.sparkSession.range(1).select(F.xxhash64(F.lit(salt), F.lit(0)).alias("s"), F.lit("").alias("plain"))
        each = hashed.select(F.explode(F.arrays_zip(F.col("ss").alias("s"), F.col("plains").alias("plain"))).alias("x")).select("x.s", "x.plain").distinct().union(mark)
        if each.groupBy("s").count().filter("count > 1").isEmpty():
            return hashed.drop("plains"), each, qs, salt


def shingle_hits(docs: DataFrame, shingles: DataFrame, qs: list[int], salt: int) -> DataFrame:
    """docs (id, h, t): rows (id, h, n_words, pos, q, s) of each place (from 1) where a shingle of the benchmark stands, and
    a row with pos 0 for each document. Texts are read once; beyond BLOCK windows' worth of shingles, once a block."""
    each = docs.select("id", "h", words(F.col("t")).alias("w"))
    # the outer form, as for the other one the optimizer adds a filter that splits all texts again
    each = each.select("id", "h", "w", F.explode_outer(F.sequence(F.lit(0), F.size("w"))).alias("pos"))
    i = F.col("pos") - 1
    rows = []
    for q in qs or [1]:
        s = F.when(F.col("pos") > 0, _shingle(F.col("w"), i, q, salt))
        first = q == (qs or [1])[0]
        mark = F.xxhash64(F.lit(salt), F.lit(0)) if first else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(q).alias("q"), F.when(F.col("pos") == 0, mark).otherwise(s).alias("s"), F.when(F.col("pos") > 0, _plain(F.col("w"), i, q)).otherwise("").alias("plain")))
    if len(rows) == 1:
        each = each.select("id", "h", "w", "pos", rows[0]["q"].alias("q"), rows[0]["s"].alias("s"))
        plain = F.when(F.col("pos") > 0, _plain(F.col("w"), i, (qs or [1])[0])).otherwise("")
    else:
        each = each.select("id", "h", "w", "pos", F.explode_outer(F.array(*rows)).alias("x")).select("id", "h", "w", "pos", "x.q", "x.s", F.col("x.plain").alias("mine"))
        plain = F.col("mine")
    parts = [each.join(b.withColumnRenamed("s", "bs"), (F.col("s") == F.col("bs")) & (F.col("plain") == plain)) for b in _blocks(shingles, "s", BLOCK * WINDOW)]
    return reduce(DataFrame.union, [p.select("id", "h", F.size("w").alias("n_words"), "pos", "q", "s") for p in parts])


def occurrences(hits: DataFrame, wins: DataFrame) -> DataFrame:
    """(k, h, start, stop, items) of each occurrence of a window, from shingle_hits() and the windows' shingles."""
    hits = hits.filter("pos > 0").withColumn("k", _key(F.col("id")))
    seen = hits.groupBy("s").count()
    each = wins.select("ss", F.posexplode("ss").alias("at", "s"))
    rarest = each.join(seen, "s").groupBy("ss").agg(F.count("*").alias("found"), F.min(F.struct("count", "s", "at")).alias("p"))
    index = wins.join(rarest, "ss").filter(F.col("found") == F.size("ss")).select("ss", "n", "items", F.col("p.s").alias("s"), F.col("p.at").alias("at"))
    parts = _blocks(stored(index, "prefixes"), "ss", BLOCK)
    union = lambda found: reduce(DataFrame.union, found)
    fits = "pos > at AND pos - at - 1 + n <= n_words"
    some = union([hits.join(b, "s").filter(fits).select("k", "h", "q") for b in parts]).distinct()
    runs = hits.join(some, ["k", "h", "q"], "left_semi").groupBy("k", "h", "q").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(F.struct("pos", "s"))).alias("a"))
    runs = runs.select("k", "h", "n_words", F.col("a.pos").alias("places"), F.col("a.s").alias("run"))
    runs = runs.select("*", F.posexplode_outer("run").alias("i", "s")).withColumn("pos", F.get("places", F.col("i")))
    same = "i >= at AND get(places, i - at) = pos - at AND i - at + size(ss) <= size(run) AND get(places, i - at + size(ss) - 1) = pos - at + size(ss) - 1 AND slice(run, i - at + 1, size(ss)) = ss"
    start = F.col("pos") - F.col("at") - 1
    return union([runs.join(b, "s").filter(f"{fits} AND {same}").select("k", "h", start.alias("start"), (start + F.col("n")).alias("stop"), "items") for b in parts])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    wins, shingles, qs, salt = benchmark_shingles(items)
    hits = stored(shingle_hits(rows, shingles, qs, salt), "hits")
    found = stored(occurrences(hits, wins), "occurrences")
    spans = found.groupBy("k", "h", "start").agg(F.max("stop").alias("stop"))
    before = Window.partitionBy("k", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy("k", "h").agg(F.sum("fresh").alias("n_hit"))
    named = found.select("k", "h", F.explode("items").alias("item")).distinct().groupBy("k", "h").agg(F.sort_array(F.collect_list("item")).alias("names"))
    per = covered.join(named, ["k", "h"], "left")
    sized = hits.filter("pos = 0").select("id", "h", F.col("n_words").cast("long").alias("n_words"), _key(F.col("id")).alias("k"))
    names, n_hit = F.coalesce("names", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    return sized.join(per, ["k", "h"], "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.col("h").alias("text_hash"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones."""
    bad = contamination(docs, items, id_col, text_col).filter("contaminated").select(F.col(id_col).alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("bad_id")) & (F.xxhash64(text_col) == F.col("bad_hash")), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs.select("doc_id", "text"), items.select("item_id", "text")).drop("text_hash")


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM dw, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.s = win.s AND pos.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
