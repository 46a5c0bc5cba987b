"""Line dedup by winnowing over line hashes.

A later repeated run is deleted: consecutive lines (blank ones aside, trimmed) that stand earlier too and number RUN = 3,
or have more than PAIR = 50 words if they are fewer, or are one line of LONG = 50 words. Such a run is a window.

Of every window the line with the smallest hash (XXH64; the last of equals) is selected. Selected lines are the
fingerprints: about half of all lines, each once, however many windows select it. A repeated run holds a window, and a
window has its fingerprint at the same place in all copies, so none is missed. A fingerprint goes with the RUN - 1 lines
on each side of it. Positions join on the fingerprint, each with the first one (smallest document, then line), so a
passage in n documents makes n - 1 pairs. The match is extended both ways as long as lines agree (by two hashes, 96
bits); windows inside it are later repeated runs, and overlapping ones chain along runs of any length. A line may stand
in many places between other lines, and its first place tells only of one. Selected windows that aren't inside the
match join once more, on the whole window, with the first that is equal. So the result is exact, and no
fingerprint's positions are compared with each other.

Only built-in expressions run on the executors, in time and memory proportional to the lines of a text.

Cases: a null text has no lines and stays null; blank lines aren't compared and stay. A text whose lines all go is
empty. Rows that repeat id and text are one document (none is the later one); with other texts they are different
documents, in the order of the texts' hashes. A null id comes first. An empty table gives an empty result. Other
columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import stored, table

RUN, LONG, PAIR = 3, 50, 50
WORD = r"[^\\x20\\x09-\\x0D]+"


def fingerprints(rows: DataFrame, run: int = RUN, long: int = LONG, pair: int | None = PAIR) -> DataFrame:
    """rows (id, th, t): (id, th, p, h, near) of each selected line; near: the lines about it (n, h, v, c), null outside."""
    seen = rows.filter("t IS NOT NULL").select("id", "th", F.expr(rf"""
        transform(filter(transform(split(t, '\n', -1), (x, i) -> struct(i AS n, btrim(x) AS s)), x -> x.s <> ''),
                  x -> struct(x.n AS n, xxhash64(x.s) AS h, hash(x.s) AS v, regexp_count(x.s, '{WORD}') AS c))""").alias("a")).filter("size(a) > 0")  # fmt: skip
    near = ", ".join(f"get(a, p + {o})" for o in range(1 - run, run))
    each = seen.select("id", "th", F.expr(f"transform(sequence(0, size(a) - 1), p -> struct(p AS p, get(a, p).h AS h, array({near}) AS near))").alias("each"))
    chosen = " OR ".join(f"{_is(k, run, long, pair)} AND {_selects(k, run)}" for k in _windows(run, pair))
    return each.select("id", "th", F.explode(F.expr(f"filter(each, x -> {chosen.replace('near[', 'x.near[')})")).alias("x")).select("id", "th", "x.*")


def _windows(run: int, pair: int | None) -> list[tuple[int, int]]:
    """(lines, first line) of the windows through a line, by their place from it."""
    return [(k, -o) for k in range(1, run + 1) if k in (1, run) or pair is not None for o in range(k)]


def _is(window: tuple[int, int], run: int, long: int, pair: int | None) -> str:
    """Whether it is a window: whole, and long enough."""
    k, o = window
    lines = [f"near[{run - 1 + o + i}]" for i in range(k)]
    enough = "true" if k == run else f"{lines[0]}.c >= {long}" if k == 1 else f"{' + '.join(x + '.c' for x in lines)} > {pair}"
    return f"({lines[0]}.h IS NOT NULL AND {lines[-1]}.h IS NOT NULL AND {enough})"


def _selects(window: tuple[int, int], run: int) -> str:
    """Whether it selects the line in the middle of near."""
    k, o = window
    mine = f"near[{run - 1}].h"
    return "(" + " AND ".join(["true"] + [f"near[{run - 1 + i}].h {'>=' if i < 0 else '>'} {mine}" for i in range(o, o + k) if i]) + ")"


def repeated(marks: DataFrame, run: int = RUN, long: int = LONG, pair: int | None = PAIR) -> DataFrame:
    """(id, th, n) of each line that goes, once."""
    # most lines stand in one place: they go before anything is compared
    again = marks.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    marks = marks.join(again, "h", "left_semi")
    first = marks.groupBy("h").agg(F.min(F.struct("id", "th", "p", "near")).alias("f"))
    met = marks.join(first, "h").filter("NOT (struct(id, th, p) <=> struct(f.id, f.th, f.p))")
    agree = lambda i: f"near[{i}].h <=> f.near[{i}].h AND near[{i}].v <=> f.near[{i}].v"
    span = lambda k: range(run - 1 + k[1], run - 1 + k[1] + k[0])
    same = lambda k: "(" + " AND ".join(agree(i) for i in span(k)) + ")"
    lines = lambda k: "array(" + ", ".join(f"near[{i}].n" for i in span(k)) + ")"
    whole = lambda k: f"xxhash64({k[0]}, {k[1]}, " + ", ".join(f"near[{i}].h, near[{i}].v" for i in span(k)) + ")"
    kinds = _windows(run, pair)
    gone = ", ".join(f"IF({_is(k, run, long, pair)} AND {same(k)}, {lines(k)}, CAST(array() AS array<int>))" for k in kinds)
    rest = ", ".join(f"IF({_is(k, run, long, pair)} AND {_selects(k, run)} AND NOT {same(k)}, struct({whole(k)} AS w, {lines(k)} AS lines), NULL)" for k in kinds)
    met = met.select("id", "th", "p", F.expr(f"array_distinct(concat({gone}))").alias("gone"), F.expr(f"filter(array({rest}), x -> x IS NOT NULL)").alias("rest"))
    met = stored(met.filter("size(gone) + size(rest) > 0"), "matches")
    more = met.select("id", "th", "p", F.explode("rest").alias("x")).select("id", "th", "p", "x.w", "x.lines")
    earliest = more.groupBy("w").agg(F.min(F.struct("id", "th", "p")).alias("f"), F.count("*").alias("c")).filter("c > 1").drop("c")
    later = more.join(earliest, "w").filter("NOT (struct(id, th, p) <=> f)")
    return met.select("id", "th", F.explode("gone").alias("n")).union(later.select("id", "th", F.explode("lines").alias("n"))).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long: int = LONG, pair: int | None = PAIR) -> DataFrame:
    """(id, n_lines, n_removed, text) of each row: the text without later repeated runs. pair None: only runs of `run`
    lines and long lines count."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    marks = stored(fingerprints(rows, run, long, pair), "fingerprints")  # read twice: to count lines, and for those that repeat
    gone = repeated(marks, run, long, pair).groupBy("id", "th").agg(F.collect_list("n").alias("gone")).select(F.col("id").alias("gid"), F.col("th").alias("gth"), "gone")
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("t", "\n", -1)))
    kept = F.expr(r"array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> get(lines, i)), '\n')")
    n_lines = F.coalesce(F.length("t") - F.length(F.translate("t", "\n", "")) + 1, F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias(text_col))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS n, trim(string_split(text, chr(10))[i]) AS s FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)),
c AS (SELECT *, len(regexp_extract_all(s, '[^\x{20}\x{09}-\x{0D}]+')) AS c FROM l WHERE s <> ''),
b AS (SELECT doc_id, n, s, c, row_number() OVER w AS p, lead(s) OVER w AS s1, lead(s, 2) OVER w AS s2, lead(n) OVER w AS n1, lead(n, 2) OVER w AS n2, lead(c) OVER w AS c1 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
g AS (SELECT *, row_number() OVER (PARTITION BY s, s1, s2 ORDER BY doc_id, p) AS k FROM b WHERE s2 IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY s, s1 ORDER BY doc_id, p) AS k FROM b WHERE s1 IS NOT NULL AND c + c1 > 50),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM b WHERE c >= 50),
gone AS (SELECT doc_id, n FROM g WHERE k > 1 UNION SELECT doc_id, n1 FROM g WHERE k > 1 UNION SELECT doc_id, n2 FROM g WHERE k > 1
  UNION SELECT doc_id, n FROM h WHERE k > 1 UNION SELECT doc_id, n1 FROM h WHERE k > 1 UNION SELECT doc_id, n FROM o WHERE k > 1),
per AS (SELECT doc_id, count(*) AS c, list(n) AS ns FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_removed,
  CASE WHEN c IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(ns, i - 1)), chr(10)) END AS text
FROM documents AS d LEFT JOIN per ON d.doc_id = per.doc_id
"""
