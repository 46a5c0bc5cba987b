"""Embedding near-dedup with an inverted multi-index.

Two independent codebooks, one for each half of the unit vectors, form a grid of K x K cells; every vector lies in
the cell of its nearest centroids. A query traverses the grid by the multi-sequence order: cells by ascending sum of
the distances to their two centroids, from its own cell on, until it is a margin beyond the first. The margin is
calibrated: vectors are drawn at exactly the threshold cosine from sampled ones, and it is the quantile of how far
their cells lie beyond the nearest. A pair is found if either of the two visits the other's cell, so a pair is missed
only if both miss: the quantile is 1 - sqrt(1 - TARGET), which makes TARGET (98 %) the aimed recall of links at the
threshold; closer ones are found more often. All vectors in visited cells are verified in double precision, and those
with cosine >= THRESHOLD (0.9) are links; links are symmetric.

K grows with the square root of the number of vectors, so a cell holds about CELL of them at every size. Codebooks
are fitted on at most SAMPLE vectors, or four for each centroid where that is more (those with the smallest hashes);
all vectors are indexed and all are queries. Equal vectors are one entry with a count. Cells are the keys of the join:
a query is sent to each cell that it visits. A cell of over BLOCK members is cut into blocks, so a task holds one block
and streams queries past it. Only counts and a forest of the linked classes leave a task, never all pairs.
Distances to centroids are whole numbers, exact in any order of summation, so both sides of a pair agree on
who visits whom.

Each length of vectors has an index of its own. Vectors of different lengths don't link.

Cases: vectors that are null, zero or hold a null or non-finite component link with nothing. A null vec_id takes no part: no links, null component, not kept. Rows that repeat a vec_id are rows of one
node. Copies link with each other. An empty table gives an empty result. Other columns are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import bounded_batches, components, stored, table

THRESHOLD, TARGET, SAMPLE, CELL, BLOCK, SEED = 0.9, 0.98, 8192, 12, 1024, 11
#: Numbers of a matrix of distances that a task holds at once.
HELD = 1 << 22
SCALE = 1 << 14


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step, square = max(1, HELD // len(c)), (c * c).sum(axis=1)
    return np.concatenate([(square - 2 * x[i : i + step] @ c.T).argmin(axis=1) for i in range(0, len(x), step)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0][:, None]
    return c


@dataclass
class Index:
    """Codebooks (whole numbers) and how far past its nearest cell a query goes."""

    books: tuple[np.ndarray, np.ndarray]
    margin: float = 0.0

    def distances(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors to all centroids of both halves, less the vector's own square."""
        x, h = np.rint(u * SCALE), self.books[0].shape[1]
        return tuple((c * c).sum(axis=1) - 2 * part @ c.T for part, c in zip((x[:, :h], x[:, h:]), self.books))

    def limit(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return d1.min(axis=1) + d2.min(axis=1) + self.margin


def traverse(d1: np.ndarray, d2: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multi-sequence traversal of a batch of queries: which query, and the cell (number i * K + j), in order of
    queries and of ascending distance, up to each query's limit. Both sequences of each query are sorted, cut where
    even the other's nearest centroid is too far, and their sums merged."""
    near = []
    for d, other in ((d1, d2), (d2, d1)):
        room = limit - other.min(axis=1)
        most = int((d <= room[:, None]).sum(axis=1).max(initial=1))
        at = np.argpartition(d, most - 1, axis=1)[:, :most] if most < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        value = np.take_along_axis(d, at, axis=1)
        order = np.lexsort((at, value))  # equal distances by number
        near.append((np.take_along_axis(at, order, axis=1), np.take_along_axis(value, order, axis=1)))
    (i, a), (j, b) = near
    total = a[:, :, None] + b[:, None, :]
    q, x, y = np.nonzero(total <= limit[:, None, None])
    cell = i[q, x].astype(np.int64) * d2.shape[1] + j[q, y]
    order = np.lexsort((cell, total[q, x, y], q))
    return q[order], cell[order]


def build(sample: np.ndarray, n: int, threshold: float = THRESHOLD, target: float = TARGET) -> Index:
    """The index for n vectors from a sample."""
    rng = np.random.default_rng(SEED)
    u, h = unit(sample), sample.shape[1] // 2
    k = max(1, min(len(u) // 4, centroids(n)))
    index = Index(tuple(np.rint(kmeans(part, k, rng) * SCALE) for part in (u[:, :h], u[:, h:])))
    q = u[:1024]
    away = rng.normal(size=q.shape)
    away = unit(away - (away * q).sum(axis=1)[:, None] * q) if q.shape[1] > 1 else 0 * q
    moved = threshold * q + math.sqrt(1 - threshold**2) * away
    beyond = []
    step = max(1, HELD // k)
    for i in range(0, len(q), step):
        d1, d2 = index.distances(q[i : i + step])
        y1, y2 = (d.argmin(axis=1) for d in index.distances(moved[i : i + step]))
        row = np.arange(len(d1))
        beyond.append(d1[row, y1] + d2[row, y2] - index.limit(d1, d2))
    index.margin = float(np.quantile(np.concatenate(beyond), 1 - math.sqrt(1 - target)))
    return index


def centroids(n: int) -> int:
    return max(1, round(math.sqrt(n / CELL)))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _forest(near: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[list, list]:
    """Edges that join what the links of a queries x members matrix join."""
    a, b = [], []
    left = near.any(axis=1)
    for i in np.flatnonzero(left):
        if left[i]:
            rows, cols, front = np.zeros(len(q), dtype=bool), np.zeros(len(m), dtype=bool), np.array([i])
            rows[i] = True
            while len(front):
                cols |= near[front].any(axis=0)
                new = near[:, cols].any(axis=1) & ~rows
                rows |= new
                front = np.flatnonzero(new)
            left &= ~rows
            for x in (*q[rows], *m[cols]):
                if x != q[i]:
                    a.append(int(x))
                    b.append(int(q[i]))
    return a, b


def _searched(index: Index, threshold: float):
    """Rows (cell, block, query, entry, copies, home, v) in order of (cell, block, query): members first, then queries.
    Gives (node, links, other): links found for an entry, or an edge of the forest (links null)."""
    k = len(index.books[1])

    def out(node, links, other):
        kinds = pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(node, type=kinds), pa.array(links, type=kinds), pa.array(other, type=kinds)], names=["node", "links", "other"])

    class Members:
        def __init__(self, node, copies, home, v):
            self.node, self.copies, self.u, self.found = node, copies, unit(v), np.zeros(len(node), dtype=np.int64)

        def visits(self, members: np.ndarray, homes: np.ndarray) -> np.ndarray:
            """Whether members visit the cells that queries are at home in."""
            met = np.empty((len(members), len(homes)), dtype=bool)
            step = max(1, HELD // (2 * k + len(homes)))
            for i in range(0, len(members), step):
                d1, d2 = index.distances(self.u[members[i : i + step]])
                met[i : i + step] = d1[:, homes // k] + d2[:, homes % k] <= index.limit(d1, d2)[:, None]
            return met

        def meet(self, node, copies, home, v):
            u = unit(v)
            cos = u @ self.u.T
            near = cos >= threshold
            for x, y in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12)):
                near[x, y] = math.fsum(u[x] * self.u[y]) >= threshold
            near &= node[:, None] != self.node[None, :]
            if not near.any():
                return
            hit, there = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            near = near[np.ix_(hit, there)]
            links = near @ self.copies[there]
            # a member that visits the query's cell finds the query there
            self.found[there] += (near.T & ~self.visits(there, home[hit])) @ copies[hit]
            yield out(node[hit], links, [None] * len(hit))
            a, b = _forest(near, node[hit], self.node[there])
            yield out(a, [None] * len(a), b)

        def close(self):
            some = np.flatnonzero(self.found)
            if len(some):
                yield out(self.node[some], self.found[some], [None] * len(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, held, asked, rows = None, None, [], [], 0

        def ask():
            if asked and members:
                yield from members.meet(*map(np.concatenate, zip(*asked)))

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, block, query, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            v = _vectors(batch.column(6))
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(cell)]):
                part = (*(r[s:e] for r in rest), v[s:e])
                if (cell[s], block[s]) != key:
                    yield from ask()
                    if members:
                        yield from members.close()
                    key, members, held, asked, rows = (cell[s], block[s]), None, [], [], 0
                if not query[s]:
                    held.append(part)
                    continue
                if held:
                    members, held = Members(*map(np.concatenate, zip(*held))), []
                asked.append(part)
                rows += e - s
                if rows >= BLOCK:
                    yield from ask()
                    asked, rows = [], 0
        yield from ask()
        if members:
            yield from members.close()

    return run


def _found(unique: DataFrame, n: int, floats: bool, threshold: float, target: float) -> DataFrame:
    """(node, links, other) of n vectors (entry, copies, v) of one length, as _searched gives them: a stored table."""
    bounded_batches(unique.sparkSession)
    sample = max(SAMPLE, 4 * centroids(n))
    chosen = unique.select("entry", "v", F.xxhash64("v").alias("h")).orderBy("h", "entry").limit(sample).toArrow().column("v").combine_chunks()
    index = build(_vectors(chosen), n, threshold, target)
    placed = unique.select("entry", "copies", "v").mapInArrow(_placed(index), "entry long, copies long, home long, cells array<long>, v array<double>")
    placed = stored(placed.withColumn("v", F.col("v").cast("array<float>" if floats else "array<double>")), "placed")
    large = placed.groupBy(F.col("home").alias("cell")).count().filter(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # few cells are large, and no query is sent anywhere to learn which
    blocks = lambda rows: rows.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = blocks(placed.withColumn("cell", F.col("home"))).withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).withColumn("query", F.lit(0))
    queries = blocks(placed.withColumn("cell", F.explode("cells"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(1))
    columns = ["cell", "block", "query", "entry", "copies", "home", "v"]
    meeting = members.select(*columns).union(queries.select(*columns)).repartition("cell", "block").sortWithinPartitions("cell", "block", "query")
    return stored(meeting.mapInArrow(_searched(index, threshold), "node long, links long, other long"), "found")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    spark = rows.sparkSession
    all_rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sane = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ok = all_rows.filter(F.col("id").isNotNull()).filter(F.coalesce(sane, F.lit(False)))
    none = all_rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    # a vector is told by its numbers; entries are numbered as they are written, so no two share a number
    grouped = ok.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    unique = stored(grouped.withColumn("entry", F.monotonically_increasing_id()), "vectors")
    counts = {r["d"]: r["count"] for r in unique.groupBy(F.size("v").alias("d")).count().collect()}  # one row a length
    if not counts:
        return none
    found = spark.createDataFrame([], "node long, links long, other long")
    for d, n in sorted(counts.items()):
        if n > 1:  # one vector has copies alone
            found = found.union(_found(unique.filter(F.size("v") == d), n, _floats(rows, vector_col), threshold, target))
    links = found.filter("links is not null").groupBy(F.col("node").alias("entry")).agg(F.sum("links").alias("links"))
    names = unique.select("entry", "node")
    edges = found.filter("other is not null").select("node", "other").join(names.select(F.col("entry").alias("node"), F.col("node").alias("a")), "node")
    edges = edges.join(names.select(F.col("entry").alias("other"), F.col("node").alias("b")), "other").select("a", "b")
    mine = ok.select("id", "v").join(unique, "v").select("id", "entry", "copies", F.col("node").alias("first"))
    own = mine.filter("copies > 1").select(F.col("id").alias("a"), F.col("first").alias("b"))
    heads = components(edges.union(own), "vectors-heads")
    per_row = mine.join(links, "entry", "left").join(heads, F.col("id") == F.col("node"), "left")
    linked = per_row.select(F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = linked.withColumn("kept", F.col(id_col) == F.col("component_id"))
    usable = F.col("id").isNotNull() & F.coalesce(sane, F.lit(False))
    rest = all_rows.filter(~usable)
    return linked.union(rest.select(F.col("id").alias(id_col), F.lit(0).cast("long"), F.col("id"), F.col("id").isNotNull()))


def _floats(rows: DataFrame, vector_col: str) -> bool:
    return rows.schema[vector_col].dataType.simpleString() == "array<float>"


def _placed(index: Index):
    k = len(index.books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit(_vectors(b.column(2))) if b.num_rows else []
            step = max(1, HELD // (8 * k))
            for i in range(0, b.num_rows, step):
                d1, d2 = index.distances(u[i : i + step])
                which, cells = traverse(d1, d2, index.limit(d1, d2))
                home = d1.argmin(axis=1).astype(np.int64) * k + d2.argmin(axis=1)
                offsets = np.searchsorted(which, np.arange(len(d1) + 1)).astype(np.int32)
                part = b.slice(i, len(d1))
                columns = [part.column(0), part.column(1), pa.array(home), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells)), part.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=["entry", "copies", "home", "cells", "v"])

    return run


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
