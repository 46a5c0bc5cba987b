"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the runs of 2, 3 and 4 bytes of its lower-cased words, each word with a space before and after it
and no run across two words, hashed into BUCKETS embeddings of DIM numbers; their average goes through a linear
softmax. Embeddings and layer are trained together by stochastic gradient descent in numpy. Beside the languages there
is a background class, taught by noise: the words of the training texts with their letters shuffled or drawn anew.

Rejection is calibrated on rows that the descent didn't see, one half for each of two steps. A temperature makes the
score of a language, its share among all classes, a probability. The threshold then lies between what right answers
score (all but REJECT of them) and what noise scores (all but REJECT_NOISE of it), half way in log odds; where the two
overlap, right answers come first. A text is rejected if its best language scores below; that language is still named.

Training takes at most SAMPLE distinct labelled texts (those with the smallest hashes, so reruns agree); they are
reduced to bucket counts on the executors, and only these, bounded by BUCKETS a row, go to the one task that fits
the model; the driver gets the model. Prediction covers every whole text.

Cases: a null text, or one without a letter, is `und` with score 0. Rows without a language teach nothing. If no
row teaches, every text is `und`. With one language all texts with letters get it. Repeated texts teach once, with the
first of their languages. An empty table gives an empty result. Other columns are not read."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import bounded_batches, stored, table

BUCKETS, DIM, SAMPLE, EPOCHS, RATE, BATCH, SEED = 1 << 13, 16, 1500, 30, 0.3, 64, 7
#: Share of a target that all classes have, weight decay a step, and letters that a text must have to make noise of.
SMOOTH, DECAY, LEAST = 0.02, 0.002, 60
REJECT, REJECT_NOISE, UNKNOWN = 0.001, 0.05, "und"
#: A text is hashed this many bytes at a time.
PIECE = 1 << 20
#: ASCII characters other than letters end a word.
TABLE = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the subwords of text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split()) + b" "
    out = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(raw), PIECE):
        a = np.frombuffer(raw[at : at + PIECE + 3], dtype=np.uint8).astype(np.uint32)
        h = a
        edge = a == 32
        for n in (2, 3, 4):
            if len(a) < n:
                break
            h = h[: len(a) - n + 1] * np.uint32(0x9E3779B1) ^ a[n - 1 :] * np.uint32(0x85EBCA77 + 2 * n)
            h = h ^ h >> np.uint32(15)
            if n > 2:  # a space inside a run means that it leaves its word
                across = edge[1 : len(a) - n + 2] if n == 3 else across[:-1] | edge[2 : len(a) - n + 3]
            kept = h[:PIECE] if n == 2 else h[:PIECE][~across[:PIECE]]
            out += np.bincount(kept & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Weights, the temperature of the softmax and the threshold under which a prediction is rejected."""

    langs: list[str]
    table: np.ndarray  # BUCKETS x (languages, background): embeddings through the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, c: np.ndarray) -> np.ndarray:
        return c @ self.table / np.maximum(c.sum(axis=-1, keepdims=True), 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(counts(text)) / self.temperature)
        best = int(p[: len(self.langs)].argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def noise(text: str, rng: np.random.Generator, most: int = 4000) -> str:
    """Words of a text (its first `most` characters) with their letters shuffled, or drawn from all of the text's."""
    words = text[:most].lower().split()
    letters = [c for w in words for c in w] or [" "]
    if rng.random() < 0.5:
        return " ".join("".join(rng.permutation(list(w))) for w in words)
    return " ".join("".join(rng.choice(sorted(set(letters)), len(w))) for w in words)


def fit(features: list[np.ndarray], labels: list[str], seed: int = SEED) -> Model:
    """features: (bucket, count) pairs of each row as a 2 x n array. labels: languages; UNKNOWN marks noise, which
    teaches the background class."""
    langs = sorted(set(labels) - {UNKNOWN})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), dtype=np.float32), np.zeros(1))
    classes = [*langs, UNKNOWN]
    rng = np.random.default_rng(seed)
    emb, layer, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(classes))), np.zeros(len(classes))
    y = np.array([classes.index(x) for x in labels])
    mean = [(f[0], (f[1] / max(1, f[1].sum())).astype(np.float32)[:, None]) for f in features]
    target = np.full((len(y), len(classes)), SMOOTH / len(classes))  # never quite sure, so that weights stay bounded
    target[np.arange(len(y)), y] += 1 - SMOOTH
    order = rng.permutation(len(y))
    held, taught = order[: len(y) // 5], order[len(y) // 5 :]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(taught), BATCH):
            rows = taught[at : at + BATCH]
            h = np.stack([(emb[mean[r][0]] * mean[r][1]).sum(axis=0) for r in rows])
            g = softmax(h @ layer + bias) - target[rows]
            back = g @ layer.T
            layer -= rate * (h.T @ g + DECAY * layer)
            bias -= rate * g.sum(axis=0) / len(rows)
            for r, b in zip(rows, back):
                emb[mean[r][0]] -= rate * 8 * mean[r][1] * b
        taught = rng.permutation(taught)
    model = Model(langs, (emb @ layer).astype(np.float32), bias)
    logits = lambda rows: np.array([(model.table[mean[r][0]] * mean[r][1]).sum(axis=0) + bias for r in rows]).reshape(-1, len(classes))
    first, second = held[::2], held[1::2]
    if len(first):
        z = logits(first)
        loss = lambda t: -(target[first] * np.log(softmax(z / t) + 1e-12)).sum(axis=1).mean()
        model.temperature = float(min(np.geomspace(0.2, 5, 81), key=loss))
    if len(second):
        p = softmax(logits(second) / model.temperature)
        best, score = p[:, :-1].argmax(axis=1), np.clip(p[:, :-1].max(axis=1), 1e-9, 1 - 1e-9)
        right, wrong = np.sort(score[best == y[second]]), np.sort(score[y[second] == len(langs)])
        low = float(right[int(REJECT * len(right))]) if len(right) else 0.0
        high = float(wrong[min(len(wrong) - 1, int((1 - REJECT_NOISE) * len(wrong)))]) if len(wrong) else 0.0
        odds = lambda x: np.log(x / (1 - x))
        model.threshold = low if high >= low or not high else float(1 / (1 + np.exp(-(odds(low) + odds(high)) / 2)))
    return model


def train(docs: DataFrame, teaches: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit a model on at most `sample` distinct texts of the rows for which `teaches` holds."""
    key = F.xxhash64(F.lit("teach"), F.col(text_col))
    rows = docs.filter(teaches & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(key.alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    # the keys of a first scan choose the texts of a second one; copies of a text are one key
    keys = sorted({r["k"] for r in rows.select("k").orderBy("k").limit(sample).collect()})
    if not keys:
        return fit([], [])
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, lang, at, n = [], [], [], []
            for key, name, text in zip(*(c.to_pylist() for c in b.columns)):
                strange = [(UNKNOWN, noise(text, np.random.default_rng(key & 0xFFFFFFFF)))] if sum(map(str.isalpha, text[:4000])) >= LEAST else []
                for kind, x in [(name, text), *strange]:
                    c = counts(x)
                    where = np.flatnonzero(c)
                    if has_letter(x):
                        k, lang, at, n = [*k, key], [*lang, kind], [*at, where.astype(np.int32)], [*n, c[where].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(lang, type=pa.string()), pa.array(at, type=pa.list_(pa.int32())), pa.array(n, type=pa.list_(pa.int32())), pa.array(k, type=pa.int64())], names=["lang", "at", "n", "k"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column(3).to_pylist(), b.column(0).to_pylist(), b.column(1), b.column(2))]
        got.sort(key=lambda r: r[:2])
        pairs = [np.stack([at.values.to_numpy(), n.values.to_numpy()]) for _, _, at, n in got]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pairs, [r[1] for r in got]))], type=pa.binary())], names=["model"])

    once = rows.filter(F.col("k").isin(keys)).groupBy("k").agg(F.min("lang").alias("lang"), F.min("t").alias("t"))
    got = once.mapInArrow(run, "lang string, at array<int>, n array<int>, k long")
    # at most two rows for each of `sample` texts meet in one task, which a lost executor's successor repeats
    return pickle.loads(got.repartition(1).mapInArrow(learn, "model binary").first()["model"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, rejected) of every row; row is the whole row as a struct."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            lang, score = [x[0] for x in found], [x[1] for x in found]
            gone = [x == UNKNOWN or s < model.threshold for x, s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(gone, type=pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")


def filtered(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects."""
    bounded_batches(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(at)]
            yield b.filter(pa.array([x != UNKNOWN and s >= model.threshold for x, s in found], type=pa.bool_()))

    return docs.select(*names).mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, ~held_out())
    out = identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "rejected")
