"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded once: those that are one pre-token and come back as one token are
proven whole. A text is cut into pre-tokens; one that is whole counts one at once, and only the rest goes
through the library's merges.

The byte-level pre-tokenizer never joins a character that isn't white space with white space after it, so a
text may be cut before every single space and each piece treated alone: pieces recur, and a bounded cache keeps
their counts. Where that isn't proven (white space in a row with a space), and for pieces with characters above U+024F, whose
classes may differ between Unicode versions, the library encodes the text or piece as it is. Special strings in
a text are left to the library's default.

Cases: a null or empty text has no bytes and no tokens. Repeated rows are returned as often as they occur. A
text of any length is taken whole. An empty table gives an empty result. Other columns are not read."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import bounded_batches, table

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: Strings that a worker's cache holds in each of its two generations, and the characters of the longest that it keeps:
#: together they bound its memory, whatever the texts.
CACHED, KEPT = 400_000, 64
#: Public pre-tokenization pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """A tokenizer by its file's name among the public ones, or by a path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def whole_tokens(name: str) -> frozenset[str]:
    """The proof: vocabulary strings that are one pre-token and encode alone as one token."""
    import regex

    t = tokenizer(name)
    strings = {s for s in t.decode_batch([[i] for i in range(t.get_vocab_size())], skip_special_tokens=False) if s and "�" not in s}
    single = sorted(s for s in strings if regex.fullmatch(PATTERN, s) and regex.findall(PATTERN, s) == [s])
    return frozenset(s for s, e in zip(single, t.encode_batch_fast(single, add_special_tokens=False)) if len(e.ids) == 1)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


def merge(model, pre_token: str) -> list:
    """The tokens of one pre-token by the vocabulary's merges alone."""
    return model.tokenize(pre_token.encode("utf-8", "surrogatepass").decode("latin-1").translate(LETTERS))


class Cache(dict):
    """A dictionary that forgets: what was not used since the last time it filled goes first. Strings of more than KEPT
    characters are made anew each time."""

    def __init__(self, make, size: int = CACHED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(key) > KEPT:
            return self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


@lru_cache(maxsize=2)
def counter(name: str):
    """A function from a text to its number of tokens."""
    import regex

    t, whole = tokenizer(name), whole_tokens(name)
    find, plain = regex.compile(PATTERN).findall, regex.compile("[\x00-ɏ]*").fullmatch
    special = [s.content for s in t.get_added_tokens_decoder().values()]

    model = t.model

    def merged(s: str) -> int:
        return len(t.encode(s, add_special_tokens=False).ids)

    words = Cache(lambda s: 1 if s in whole else len(merge(model, s)))

    def of_piece(s: str) -> int:
        if s[1:].isascii():
            if s[1:].isalpha() and s[0] == " ":
                return words[s]
            if s[1:-1].isalpha() and s[0] == " " and s[-1] in ".,;:!?":
                return words[s[:-1]] + words[s[-1]]
        if not plain(s) or any(x in s for x in special):
            return merged(s)
        found = find(s)
        return sum(map(words.__getitem__, found))

    unproven = 1 << 50
    spaced = Cache(lambda s: of_piece(" " + s) if s and not s[0].isspace() and not s[-1].isspace() else unproven)

    def of_text(text: str) -> int:
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()) or any(" " in x and x in text for x in special):
            return merged(text)
        n = of_piece(first) + sum(map(spaced.__getitem__, rest))
        return n if n < unproven else merged(text)

    return of_text


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            n = np.fromiter((count(x) if x else 0 for x in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)] + [b.column(2)], names=["id", "n", "bytes"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    out = rows.mapInArrow(run, f"id {kind}, n long, bytes long")
    return out.select(F.col("id").alias(id_col), F.col("bytes").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
