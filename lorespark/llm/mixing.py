"""Mixing sources to target weights along a time-varying curriculum.

Sources in code point order, null last, get WEIGHTS in turn and share SHARE (150 %) of all words by weight; a
target stops at REPEAT = 2 times its source's words and the excess is shared again by weight until none is above.
Those targets are min(cap, level * weight) for one level, found from the sources sorted by cap over weight.

Inside a source documents stand in a fixed random order (md5 of the id) and lie one after another on the source's
word axis, pass after pass. Over training time t in 0..1 the source's weight is 1 + a * (2t - 1) times its mean (a
from RAMPS): its cumulative demand is the integral target * ((1 - a) * t + a * t^2), and inverting that at a
document's place on the axis gives its training position in each pass. Documents are range-sorted by position.
What a mix takes of a document are its words on the axis before the target.

Places need running sums over a source, which may hold a third of all rows: each source is cut by the first three
digits of the md5 into 4096 buckets, sums of buckets are accumulated first, and only within a bucket are rows
sorted. Only built-in expressions run on the executors. One row per source goes through one task.

Cases: a null or empty text has size 0 and nothing is taken of it (its position is still defined, unless its
source's target is 0, where it is null). A null source is a source of its own, after all others; so is the empty
string, before them. Rows that repeat an id are documents of their own, ordered by size. Empty tables give empty
results. Clashing column names don't matter: rows are carried as a struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import stored, table

WEIGHTS, SHARE, REPEAT, RAMPS = (3, 1, 2), 1.5, 2, (-0.5, 0.0, 0.5)
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, ramps=RAMPS) -> DataFrame:
    """sources (src, total), one row each: adds target and ramp."""
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("src"))) - 1
    of = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), rank % len(values) + 1)
    rows = sources.select("src", "total", of(weights).alias("weight"), of(ramps).alias("ramp"), (F.col("total") * repeat).cast("double").alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("src"))
    prior, everywhere = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(float(share)) * F.sum("total").over(everywhere) - F.coalesce(F.sum("cap").over(prior), F.lit(0.0))
    free = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(prior), F.lit(0.0))
    rows = rows.withColumn("at", F.row_number().over(by_ratio)).withColumn("level", left / free)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("at", "level"))
    level = F.min(fits).over(everywhere)["level"]
    return rows.select("src", "total", "ramp", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def position(place: Column, target: Column, ramp: Column) -> Column:
    """Training time at which the source's demand reaches place: the inverse of its integral."""
    u = F.least(F.lit(1.0), place / target)
    return F.when(target > 0, 2 * u / ((1 - ramp) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u)))


def mixed(rows: DataFrame, **options) -> DataFrame:
    """rows (row, id, src, size): adds total, target, taken, and of each pass what is taken (taken_1, taken_2)
    and its position (position_1, position_2)."""
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    name = F.coalesce(F.concat(F.lit("s"), "src"), F.lit("n"))
    rows = rows.select("row", "id", "src", "size", key.alias("order"), name.alias("name"), F.substring(key, 1, 3).alias("bucket"))
    sums = rows.groupBy("name", "src", "bucket").agg(F.sum("size").alias("words"))
    aims = targets(sums.groupBy("name", "src").agg(F.sum("words").alias("total")).select("src", "total"), **options)
    aims = aims.withColumn("name", F.coalesce(F.concat(F.lit("s"), "src"), F.lit("n"))).select("name", "total", "target", "ramp")
    run = Window.partitionBy("name").orderBy("bucket")
    based = sums.withColumn("base", F.sum("words").over(run) - F.col("words")).select("name", "bucket", "base").join(aims, "name")
    inside = Window.partitionBy("name", "bucket").orderBy("order", F.asc_nulls_first("id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(based, ["name", "bucket"]).withColumn("place", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    goal = F.least(F.floor(F.col("target") + 0.5).cast("long"), 2 * F.col("total"))
    taken = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - F.col("place") - p * F.col("total"))) for p in (0, 1)]
    where = [position(F.col("place") + p * F.col("total"), F.col("target"), F.col("ramp")) for p in (0, 1)]
    out = placed.select("row", "id", "size", "total", "target", taken[0].alias("taken_1"), taken[1].alias("taken_2"), where[0].alias("position_1"), where[1].alias("position_2"))
    return out.withColumn("taken", F.col("taken_1") + F.col("taken_2"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs in training order, range-sorted by position: a document stands once for each pass that takes at least
    half of its words (whole texts only). Columns are those of docs."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("src"), size_of(F.col(text_col)).alias("size"))
    one = lambda p: F.when((F.col("size") > 0) & (2 * F.col(f"taken_{p}") >= F.col("size")), F.col(f"position_{p}"))
    each = mixed(rows).select("row", "id", F.explode(F.array_compact(F.array(one(1), one(2)))).alias("position"))
    return each.repartitionByRange("position", "id").sortWithinPartitions("position", "id").select("row.*")


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    rows = rows.select(F.lit(0).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("src"), "size")
    out = mixed(rows)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("total").alias("source_size"), "target", "taken", *[F.when(F.col(f"taken_{p}") > 0, F.round(f"position_{p}", 9)).alias(f"position_{p}") for p in (1, 2)])


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT source, total, [3.0, 1.0, 2.0][turn + 1]::DOUBLE AS weight, [-0.5, 0.0, 0.5][turn + 1]::DOUBLE AS ramp, (2 * total)::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS nr, (1.5::DOUBLE * sum(total) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, total, ramp, least(cap, weight * (SELECT arg_min(level, nr) FROM l WHERE level * weight <= cap)) AS target FROM l),
p AS (SELECT doc_id, size, total, target, ramp, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS place, least(floor(target + 0.5)::BIGINT, 2 * total) AS goal FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, goal - place)) AS t1, greatest(0, least(size, goal - place - total)) AS t2, least(1.0::DOUBLE, place / target) AS u1, least(1.0::DOUBLE, (place + total) / target) AS u2 FROM p)
SELECT doc_id, size, total AS source_size, target, (t1 + t2)::BIGINT AS taken,
  CASE WHEN t1 > 0 AND target > 0 THEN round(2 * u1 / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u1)), 9) END AS position_1,
  CASE WHEN t2 > 0 AND target > 0 THEN round(2 * u2 / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u2)), 9) END AS position_2
FROM q
"""
