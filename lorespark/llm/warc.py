"""WARC derivatives: from each response record a linked metadata record and a plain-text conversion record.

Both get WARC-Refers-To (the response's WARC-Record-ID), its target URI and date as WARC-Refers-To-Target-URI and -Date,
and every header of the response, digests among them, as X-Source-* headers; the metadata block lists them as well.
Record ids are UUIDs made of the source id and the kind, so a run that is repeated names the same records. Digests of
what is new (the block of each, and the text as payload of the conversion) are sha1 in base32. Records that aren't
responses are left out.

The HTTP body is decoded: chunked transfer, then gzip, deflate or zstd content, then the character set. The metadata
block (application/warc-fields) holds the HTTP status, header fields, title, language, the check of the source's
payload digest and the outlinks. Values come from pages and servers, so control characters in them, line ends above
all, become spaces. The conversion block is the text: of HTML with script, style, comments and tags removed, block
elements on lines of their own, character references resolved, white space collapsed; of other text as it is. Types
that aren't text, and content that can't be decoded, give metadata only, which says so.

Markup is read once from left to right, in time proportional to its length, whatever is left open in it: a comment, a
tag or a script that doesn't end is text. write_warc() stores derivatives in WARC files.

Cases: a record that can't be parsed, or is null, gives one row of type `error` with the reason; so does the rest of
a file that is cut or broken. A body that is empty or null gives a conversion record of length 0. A response without
an id is given one made of its bytes. Repeated records give repeated derivatives with the same ids. Texts of any
length are taken whole. Empty tables give empty results. Other columns are not read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import bounded_batches, open_folder, stored, table

VERSION = b"WARC/1.1"
#: Elements whose content is not text.
HIDDEN = ("script", "style", "noscript", "template")
#: Elements that stand on lines of their own.
BLOCKS = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer title head body html blockquote pre".split())
COLUMNS = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, content_length long, block string, record binary"
CONTROL = re.compile("[\x00-\x1f\x7f-\x9f  ]+")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9]*")
HREF = re.compile(r"""[\s"'/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LANG = re.compile(r"""[\s"'/]lang\s*=\s*["']?([\w-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def same_digest(given: str, data: bytes) -> bool:
    """Whether a labelled digest, in base32 or hexadecimal, is that of data; False for algorithms not known here."""
    name, _, value = given.partition(":")
    try:
        raw = hashlib.new(name.lower().replace("-", ""), data).digest()
    except ValueError:
        return False
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, source + '#' + kind)}>"


def fields(head: bytes) -> list[tuple[str, str]]:
    """Header lines; a line that begins with white space continues the one before."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[list[tuple[str, str]], bytes, int]:
    """Headers and block of the record at an offset, and where the next begins."""
    end = data.find(b"\r\n\r\n", at)
    if data[at : at + 5] != b"WARC/" or end < 0:
        raise ValueError("no WARC record here")
    first = data.find(b"\r\n", at)
    headers = fields(data[first + 2 : end])
    size = next((int(v) for k, v in headers if k.lower() == "content-length"), None)
    if size is None or size < 0 or len(data) < end + 4 + size:
        raise ValueError("record is cut short")
    return headers, data[end + 4 : end + 4 + size], min(len(data), end + 8 + size)


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, each unpacked; a file that isn't gzip is one. Packed bytes are handed over in steps,
    so a member costs what it holds, wherever it stands in the file."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while at < len(data):
        d, out, end = zlib.decompressobj(31), [], at
        while not d.eof:
            if end >= len(data):
                raise ValueError("a gzip member is cut short")
            step = view[end : end + (1 << 16)]
            try:
                out.append(d.decompress(step))
            except zlib.error as e:
                raise ValueError(f"broken gzip member: {e}") from e
            end += len(step)
        at = end - len(d.unused_data)
        yield b"".join(out)


def records(data: bytes) -> Iterator[bytes]:
    """The records of a file, plain or gzip members; ValueError where the rest can't be read."""
    for member in members(data):
        at = 0
        while at < len(member):
            _, _, after = parse(member, at)
            yield member[at:after]
            at = after


def one_line(value: str) -> str:
    """A field's value: no line end in it can begin another field."""
    return CONTROL.sub(" ", value).strip()


class Page:
    """Text, title, language and links of markup, read in one pass."""

    def __init__(self, markup: str):
        self.markup, self.title, self.language, self.links = markup, None, None, []
        self.low, self.last = None, {c: markup.rfind(c) for c in "\"'>"}
        self.gone: set[str] = set()  # ends that don't occur any more
        self.quoted = True
        parts, at = [], 0
        while (tag := markup.find("<", at)) >= 0:
            parts.append(markup[at:tag])
            part, at = self._tag(tag)
            parts.append(part)
        self.text = tidy("".join([*parts, markup[at:]]))

    def _until(self, end: str, at: int) -> int:
        """Where an end (lower case) begins, or -1; what wasn't found once isn't looked for again."""
        if end in self.gone:
            return -1
        if self.low is None:
            low = self.markup.lower()
            self.low = low if len(low) == len(self.markup) else "".join(c.lower() if c.isascii() else c for c in self.markup)
        found = self.low.find(end, at)
        if found < 0:
            self.gone.add(end)
        return found

    def _close(self, at: int) -> int:
        """The place after the > that ends a tag; -1 if there is none."""
        if self.quoted:
            i = at
            while m := QUOTE.search(self.markup, i):
                c = m[0]
                if c == ">":
                    return m.end()
                i = m.end() if self.last[c] < m.end() else self.markup.find(c, m.end()) + 1
            self.quoted = False  # quotes that swallow all that follows aren't quotes
        return self.markup.find(">", at) + 1 or -1 if self.last[">"] >= at else -1

    def _tag(self, at: int) -> tuple[str, int]:
        """What stands for a tag that begins at a place, and where it ends."""
        s = self.markup
        if s.startswith("<!--", at):
            end = self._until("-->", at + 4)
            return (" ", end + 3) if end >= 0 else ("<", at + 1)
        m = NAME.match(s, at + 1 + (s[at + 1 : at + 2] in ("/", "!", "?")))
        end = self._close(m.end()) if m else -1
        if end < 0:
            return "<", at + 1
        name, opens = m[0].lower(), m.start() == at + 1
        if opens and name in HIDDEN:
            close = self._until(f"</{name}", end)
            if close >= 0:
                after = self._close(close + 2 + len(name))
                return " ", after if after >= 0 else len(s)
        if opens and name == "a":
            self.links += [html.unescape(x) for h in [HREF.search(s, m.end(), end)] if h for x in [h[1] if h[1] is not None else h[2] if h[2] is not None else h[3]]]
        if opens and name == "html" and self.language is None:
            lang = LANG.search(s, m.end(), end)
            self.language = lang and lang[1]
        if opens and name == "title" and self.title is None:
            close = self._until("</title", end)
            self.title = tidy(s[end:close]).replace("\n", " ") if close >= 0 else None
        return ("\n" if name in BLOCKS else " "), end


QUOTE = re.compile("[>\"']")


def tidy(text: str) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in html.unescape(text).split("\n")) if x)


def dechunked(body: bytes) -> bytes:
    """The body of a chunked transfer; ValueError if it isn't one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk without a size")
        size = int(body[at:end].split(b";")[0].strip() or b"-", 16)
        if size <= 0:
            return b"".join(out)
        if len(body) < end + 2 + size:
            raise ValueError("a chunk is cut short")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def content(body: bytes, encoding: str) -> bytes:
    """A body without its content encodings, the last one first; ValueError for what can't be undone."""
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = gzip.decompress(body) if body else body
            elif name == "deflate":
                body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15) if body else body
            elif name == "zstd":
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif name != "identity":
                raise ValueError(f"no decoder for {name}")
        except (OSError, EOFError, zlib.error, zstandard.ZstdError) as e:
            raise ValueError(f"{name}: {e}") from e
    return body


def is_markup(kind: str) -> bool:
    return kind in ("", "text/html") or "xml" in kind


def is_text(kind: str, body: bytes) -> bool:
    """By the media type; a body without one is text if it has no zero byte."""
    return kind.startswith("text/") or "xml" in kind or kind.endswith("json") or kind == "application/javascript" or not kind and b"\x00" not in body


def derive(data: bytes) -> list[dict]:
    """The metadata and conversion records of a response record."""
    headers, block, _ = parse(data)
    of = {k.lower(): v for k, v in reversed(headers)}
    if of.get("warc-type", "").lower() != "response":
        return []
    source = of.get("warc-record-id") or record_id(digest(data), "response")
    head, _, raw = block.partition(b"\r\n\r\n")
    status, _, rest = head.partition(b"\r\n")
    http = fields(rest)
    said = {k.lower(): v for k, v in reversed(http)}
    kind = said.get("content-type", "")
    media, body, wrong, given = kind.partition(";")[0].strip().lower(), raw, "", of.get("warc-payload-digest")
    try:
        if "chunked" in said.get("transfer-encoding", "").lower():
            body = dechunked(raw)
        sent = body
        body = content(body, said.get("content-encoding", ""))
    except ValueError as e:
        wrong, sent = f"{e}", body
    verified = "no source digest" if not given else "yes" if same_digest(given, raw) or same_digest(given, sent) else f"no, is {digest(raw)}"
    page, text = None, None
    if not wrong and is_text(media, body):
        charset = (re.search(r"charset=[\"']?([\w-]+)", kind, re.I) or re.search(r"<meta[^>]+charset=[\"']?([\w-]+)", body[:2048].decode("latin-1"), re.I) or [None, "utf-8"])[1]
        try:
            markup = body.decode(charset, "replace")
        except (LookupError, ValueError):
            markup = body.decode("utf-8", "replace")
        page = Page(markup) if is_markup(media) else None
        text = page.text if page else markup
    meta = [("http-status", (status.decode("latin-1").split(" ") + ["", ""])[1]), *((f"http-{k.lower()}", v) for k, v in http)]
    meta += [("title", page.title)] if page and page.title else []
    meta += [("language", page.language)] if page and page.language else []
    meta += [("payload-digest-verified", verified)]
    meta += [("no-conversion", wrong or media or "binary content")] if text is None else []
    meta += [(f"source-{k.lower()}", v) for k, v in headers]
    meta += [("outlink", x) for x in (page.links if page else [])]
    made = [("metadata", "application/warc-fields", "".join(f"{one_line(k)}: {one_line(v)}\r\n" for k, v in meta).encode("utf-8", "replace"))]
    made += [("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))] if text is not None else []
    out = []
    for name, content_type, data in made:
        own = [("WARC-Type", name), ("WARC-Record-ID", record_id(source, name)), ("WARC-Refers-To", source)]
        own += [(k, of[k.lower()]) for k in ("WARC-Target-URI", "WARC-Date") if k.lower() in of]
        own += [(k.replace("WARC-", "WARC-Refers-To-"), of[k.lower()]) for k in ("WARC-Target-URI", "WARC-Date") if k.lower() in of]
        own += [("WARC-Block-Digest", of_block := digest(data)), *([("WARC-Payload-Digest", of_block)] if name == "conversion" else []), ("Content-Type", content_type)]
        own += [(f"X-Source-{k}", v) for k, v in headers]
        own = [(one_line(k), one_line(v)) for k, v in own]
        out.append({"record_type": name, "record_id": own[1][1], "refers_to": source, "target_uri": of.get("warc-target-uri"), "date": of.get("warc-date"), "content_type": content_type, "payload_digest": given, "block_digest": of_block, "content_length": len(data), "block": data.decode(), "record": serialize(own, data)})
    return out


def derivatives(rows: DataFrame, key_col: str, record_col: str) -> DataFrame:
    """(key, COLUMNS) for each response record in a binary column."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema[key_col].dataType.simpleString()
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = {"content_length": pa.int64(), "record": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, made = [], []
            for i, data in enumerate(b.column(1)):
                try:
                    found = derive(data.as_py() or b"")
                except ValueError as e:
                    found = [{"record_type": "error", "block": str(e)}]
                at += [i] * len(found)
                made += found
            columns = [b.column(0).take(pa.array(at, type=pa.int64()))] + [pa.array([m.get(n) for m in made], type=types.get(n, pa.string())) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=["key", *names])

    out = rows.select(F.col(key_col).alias("key"), F.col(record_col).alias("r")).mapInArrow(run, f"key {kind}, {COLUMNS}")
    return out.withColumnRenamed("key", key_col)


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): each page as the response record a crawler would have written."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    body = F.col("html")
    head = F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "UTF-8")
    hex_id = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))))
    urn = F.regexp_replace(hex_id, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), urn, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(body) + F.octet_length(head)).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select("page_id", F.concat(F.encode(lines, "UTF-8"), head, body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def read_warc(spark, path: str) -> DataFrame:
    """(path, record, error) of WARC files; a file (of up to 2 GB) is the unit of work, a record a row. What can't be
    read any further gives a row with the reason and no record; the records before it stay."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(p, r, e):
            return pa.RecordBatch.from_arrays([pa.array([p]), pa.array([r], type=pa.binary()), pa.array([e], type=pa.string())], names=["path", "record", "error"])

        for b in batches:
            for p, data in zip(b.column(0), b.column(1)):
                try:
                    for r in records(data.as_buffer().to_pybytes() if hasattr(data, "as_buffer") else data.as_py()):
                        yield out(p.as_py(), r, None)
                except ValueError as e:
                    yield out(p.as_py(), None, str(e))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, record binary, error string")


def write_warc(rows: DataFrame, path: str, most: int = 1 << 30) -> DataFrame:
    """Write the records (column record) as WARC files of about `most` bytes, a gzip member each, under path; returns a
    stored table (file, records, bytes). Rows without a record are left out. A task that runs again writes the same files."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, f = TaskContext.get().partitionId(), 0, None
        store, at = open_folder(path)
        store.create_dir(at, recursive=True)

        def close() -> pa.RecordBatch:
            f.close()
            store.move(temp, f"{at}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count]), pa.array([size])], names=["file", "records", "bytes"])

        for b in batches:
            for r in b.column(0):
                if f is None:
                    name, count, size = f"{part:06d}-{seq:04d}.warc.gz", 0, 0
                    temp = f"{at}/.{name}.{uuid.uuid4().hex}"
                    f = store.open_output_stream(temp, compression=None)
                f.write(data := gzip.compress(r.as_py(), 6, mtime=0))
                count, size = count + 1, size + len(data)
                if size >= most:
                    yield close()
                    f, seq = None, seq + 1
        if f is not None:
            yield close()

    return stored(rows.select("record").filter("record IS NOT NULL").mapInArrow(run, "file string, records long, bytes long"), "warc")


def op1_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    out = derivatives(responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")), "page_id", "record")
    return out.withColumn("record_sha256", F.sha2("record", 256)).drop("record")
