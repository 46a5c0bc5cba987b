"""Token ids in wavelet matrix files, one per shard.

File format, little-endian: the magic LSWM0001, a 32-bit header length, a JSON header (n tokens, bits, documents,
zeros per plane, and offset and length of every section), then sections, each its own zstd frame: document starts
(uint64, one more than documents), for each bit-plane, highest bit first, its packed bits and a rank directory
(uint32: ones before each block of 512 bits), and the documents' ids as JSON. Planes are read only when asked for, so one token, a count or an
occurrence costs its path through the planes, not the shard.

access(i), rank(token, i), select(token, k), count(token) and occurrences(token) work on the planes; decode()
inverts the whole matrix plane by plane.

Documents are range-sorted by id, or by a column the caller names, and each task cuts its range into shards of about SHARD tokens (a document stays
in one shard). A shard is named by its range and its place in it, so a task that runs again writes the same files.

Cases: a null or empty text holds the end id alone. Rows with the same id are separate documents, ordered by text.
A null id comes first. An empty table writes no shard and gives an empty result. Other columns are not read."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from lorespark.llm.common import bounded_batches, in_order, new_path, open_folder, stored, table
from lorespark.llm.tokens import CACHED, Cache, merge, tokenizer

#: Public pre-tokenization pattern of the vocabulary with word ends (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
VOCABULARY, END, SHARD, MAGIC, BLOCK = "word_bpe_49k.json", 1, 1 << 20, b"LSWM0001", 512


def build(ids: np.ndarray, starts: np.ndarray, names: list | None = None) -> bytes:
    """The file of one shard. ids: its tokens (uint32); starts: where each document begins, and len(ids); names: the
    documents' ids."""
    n, bits = len(ids), max(1, int(ids.max(initial=1)).bit_length())
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    then = np.empty_like(now)
    sections, zeros = [starts.astype("<u8").tobytes()], []
    for level in range(bits - 1, -1, -1):
        one = (now & now.dtype.type(1 << level)) != 0
        packed = np.packbits(one, bitorder="little")
        packed = np.pad(packed, (0, -len(packed) % (BLOCK // 8)))
        per = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        sections += [packed.tobytes(), np.r_[np.uint32(0), np.cumsum(per, dtype=np.uint32)].astype("<u4").tobytes()]
        zeros.append(n - int(np.count_nonzero(one)))
        np.compress(~one, now, out=then[: zeros[-1]])
        np.compress(one, now, out=then[zeros[-1] :])
        now, then = then, now
    sections.append(json.dumps(names or []).encode())
    pack = zstandard.ZstdCompressor(level=1)
    frames = [pack.compress(s) for s in sections]
    at = np.cumsum([0, *map(len, frames)]).tolist()
    header = json.dumps({"n": n, "bits": bits, "docs": len(starts) - 1, "zeros": zeros, "at": at}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(frames)


class Shard:
    """A wavelet matrix over the bytes of a shard file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        size = struct.unpack("<I", data[8:12])[0]
        self.head, self.data, self.base, self.kept = json.loads(data[12 : 12 + size]), data, 12 + size, {}
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]

    def section(self, i: int) -> bytes:
        if i not in self.kept:
            a, b = self.head["at"][i : i + 2]
            self.kept[i] = zstandard.ZstdDecompressor().decompress(self.data[self.base + a : self.base + b])
        return self.kept[i]

    @property
    def starts(self) -> np.ndarray:
        return np.frombuffer(self.section(0), dtype="<u8")

    @property
    def ids(self) -> list:
        """The documents' ids."""
        return json.loads(self.section(1 + 2 * self.bits))

    def bit(self, level: int, i: int) -> int:
        return self.section(1 + 2 * level)[i >> 3] >> (i & 7) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        raw, ranks = self.section(1 + 2 * level), np.frombuffer(self.section(2 + 2 * level), dtype="<u4")
        block = i // BLOCK
        whole = int.from_bytes(raw[block * BLOCK // 8 : (i + 7) // 8], "little") & ((1 << i - block * BLOCK) - 1)
        return int(ranks[block]) + whole.bit_count()

    def _down(self, level: int, one: int, i: int) -> int:
        ones = self.ones(level, i)
        return self.zeros[level] + ones if one else i - ones

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            one = self.bit(level, i)
            value, i = value << 1 | one, self._down(level, one, i)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(self.bits):
            one = token >> self.bits - 1 - level & 1
            lo, hi = self._down(level, one, lo), self._down(level, one, hi)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        if token >> self.bits:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the occurrence number k (from 0) of token; IndexError if there are fewer."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.rank(token, mid + 1) > k else (mid + 1, hi)
        return lo

    def occurrences(self, token: int) -> Iterator[int]:
        return (self.select(token, k) for k in range(self.count(token)))

    def decode(self) -> np.ndarray:
        """All tokens, by undoing each plane's stable partition from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        below = np.zeros(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(np.frombuffer(self.section(1 + 2 * level), dtype=np.uint8), count=self.n, bitorder="little").view(bool)
            here = np.empty(self.n, dtype=kind)
            here[np.flatnonzero(~one)] = below[: self.zeros[level]]
            here[np.flatnonzero(one)] = below[self.zeros[level] :] | kind(1 << self.bits - 1 - level)
            below = here
        return below.astype(np.uint32)


@lru_cache(maxsize=2)
def encoder(name: str):
    """A function from a text column to the ids of all its texts, one after another, and the number of each. The
    vocabulary drops white space and no pre-token crosses it, so each stretch between white space is encoded alone:
    cut into pre-tokens, and each of these merged. A bounded cache keeps the ids of both. Texts with special strings
    or characters above U+024F, whose classes may differ between Unicode versions, are the library's as they are."""
    import regex

    t = tokenizer(name)
    model, find, plain = t.model, regex.compile(PATTERN).findall, regex.compile("[\x00-ɏ]*").fullmatch
    special = [s.content for s in t.get_added_tokens_decoder().values()]
    library = lambda s: array("I", t.encode(s, add_special_tokens=False).ids).tobytes()
    #: Characters that Python takes for white space and the vocabulary's pattern doesn't.
    odd = [chr(c) for c in range(0x1C, 0x20)]

    def stretch(s: str) -> bytes:
        if s.isalpha():
            return array("I", [x.id for x in (model.tokenize(s) if s.isascii() else merge(model, s))]).tobytes()
        if s[:-1].isalpha() and s[-1] in ".,;:!?":
            return cache[s[:-1]] + points[s[-1]]
        found = find(s)
        if found == [s]:
            return array("I", [x.id for x in merge(model, s)]).tobytes()
        return b"".join(map(cache.__getitem__, found))

    cache = Cache(stretch, 2 * CACHED)
    points = {c: array("I", [x.id for x in merge(model, c)]).tobytes() for c in ".,;:!?"}

    def of_text(text: str) -> bytes:
        if not (text.isascii() or plain(text)) or any(c in text for c in odd) or any(x in text for x in special):
            return library(text)
        return b"".join(map(cache.__getitem__, text.lower().split()))

    def of_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [of_text(x) if x else b"" for x in column.to_pylist()]
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4

    return of_texts


def write_shards(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", order: str | None = None) -> DataFrame:
    """Write docs in ascending id order, or in that of the column `order`, as shard files under path; returns the
    manifest, a stored table with a row a file: the range (part) it comes from, its place in it (seq), file and
    tokens. Ranges ascend, so (part, seq) is the order of the files."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list = []
        seq = 0

        def flush(tokens: np.ndarray, lengths: np.ndarray, ids: list) -> pa.RecordBatch:
            data = build(tokens, np.r_[0, np.cumsum(lengths)], ids)
            name = f"{part:08d}-{seq:06d}.lswm"
            store, at = open_folder(path)
            store.create_dir(at, recursive=True)
            temp = f"{at}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temp, compression=None) as f:
                f.write(data)
            store.move(temp, f"{at}/{name}")  # onto the same file, if a lost task wrote it before
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([name]), pa.array([len(tokens)])], names=["part", "seq", "file", "tokens"])

        for b in batches:
            tokens, lengths = encode(b.column(1))
            held.append(np.insert(tokens, np.cumsum(lengths), end))
            sizes.append(lengths + 1)
            names += b.column(0).to_pylist()
            tokens, lengths = np.concatenate(held), np.concatenate(sizes)
            upto = np.cumsum(lengths)
            first = done = 0
            while len(upto) and upto[-1] - done >= shard:
                last = int(np.searchsorted(upto, done + shard)) + 1
                yield flush(tokens[done : upto[last - 1]], lengths[first:last], names[first:last])
                first, done, seq = last, int(upto[last - 1]), seq + 1
            held, sizes, names = [tokens[done:]], [lengths[first:]], names[first:]
        if names:
            yield flush(held[0], sizes[0], names)

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), *([F.col(order).alias("o")] if order else [F.xxhash64(text_col).alias("o")]))
    by = [F.asc("o")] if order else [F.asc_nulls_first("i"), F.asc("o")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ordered.mapInArrow(run, "part long, seq long, file string, tokens long"), "manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of tokens before each file (base): sums of ranges first, then within a range, so
    one task sees a row a range only."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return manifest.withColumn("inside", inside).join(before, "part").select("part", "seq", "file", "tokens", (F.col("before") + F.col("inside")).alias("base"))


def read_shards(manifest: DataFrame, path: str, kind: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, read from the files of a manifest. kind: the type of ids."""
    # a task for a few shards each, however small the manifest is
    jobs = placed(manifest).select("file", "base", "tokens").repartition(manifest.count() // 4 + 1, "file")
    id_type = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_folder(path)
        for b in batches:
            for file, base, tokens in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_stream(f"{at}/{file}", compression=None) as f:
                    s = Shard(f.read())
                if s.n != tokens:
                    raise ValueError(f"{file} holds {s.n} tokens, the manifest says {tokens}")
                starts, flat = s.starts.astype(np.int64), s.decode().astype("<u4")
                crc = [zlib.crc32(flat[a:z]) for a, z in zip(starts[:-1], starts[1:])]
                columns = [pa.array(s.ids, type=id_type), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, type=pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "n_tokens", "ids_crc32"])

    return jobs.mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str = VOCABULARY, order: str | None = None) -> DataFrame:
    """Write docs to shards in the shared folder, by id or by the column `order`, and read every document back."""
    path = new_path(docs.sparkSession, "shards")
    manifest = write_shards(docs, path, vocabulary, order=order)
    out = read_shards(manifest, path, docs.schema["doc_id"].dataType.simpleString())
    out._lorespark_shards = (manifest, path)
    return out


def training_output(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """token_output of docs in the order they come in, which is the curriculum's."""
    return token_output(in_order(docs, "__order"), vocabulary, order="__order")


def op5_wavelet_tokens(spark, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents").select("doc_id", "text"))
