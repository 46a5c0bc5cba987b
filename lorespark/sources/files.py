"""Readers of text, Markdown, CSV and DOCX files. A file is read whole by Spark (any store that Spark reads) and its
records are made per file; a file that can't be read gives no record and its error instead of a failed job."""

from __future__ import annotations

import csv
import io
import os
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.sources import pdf

SCHEMA = "source_path string, record_index int, title string, text string, md5 string, row_number int, source_type string, error string"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


FILES = "path string, modificationTime timestamp, length long, content binary"


def scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".md",)) -> DataFrame:
    """Files under a folder with one of the suffixes in any case, without lock files, in order of their paths: path,
    content, length, time, md5, doc_type. A folder that isn't there has none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path) if there else spark.createDataFrame([], FILES)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1))
    kept = files.filter(suffix.isin(*[x.lower() for x in suffixes]) & ~name.startswith("~$"))
    return kept.withColumn("md5", F.md5("content")).withColumn("doc_type", suffix).orderBy("path")


def listing(files: DataFrame) -> DataFrame:
    """Scanned files as a page lists them, the latest first: name, title, path, doc_type, size_bytes, updated_at."""
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    rows = files.select(name.alias("name"), F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "").alias("title"), "path", "doc_type", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("updated_at"))
    return rows.orderBy(F.desc("updated_at"), F.lower("name"), "path")


def csv_records(data: bytes, base: str) -> list[tuple]:
    out = []
    for n, row in enumerate(csv.DictReader(io.StringIO(data.decode("utf-8-sig"), newline="")), 1):
        if None in row:
            raise ValueError(f"row {n} has more cells than the header")
        cells = [f"{k}: {v.strip()}" for k, v in row.items() if v and v.strip()]
        out.append((f"{base} 第 {n} 行", "\n".join(cells), n, "csv_row"))
    return out


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    parts = ("".join(t.text or "" for t in p.iter(WORD + "t")).strip() for p in root.iter(WORD + "p"))
    return "\n\n".join(p for p in parts if p)


def load_records(files: DataFrame, pages: Callable[[bytes], list[str]] = pdf.pypdf_pages) -> DataFrame:
    """The records of scanned files, one a page of a PDF (read by `pages`), one a row of a CSV, one of any other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, data, md5, kind in zip(frame.path, frame.content, frame.md5, frame.doc_type):
                base = os.path.basename(unquote(path))
                stem = os.path.splitext(base)[0]
                try:
                    if kind in (".txt", ".md"):
                        text = data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n").strip()
                        found = [(stem, text, None, None)]
                    elif kind == ".csv":
                        found = csv_records(data, base)
                    elif kind == ".docx":
                        found = [(stem, docx_text(data), None, None)]
                    else:
                        raise ValueError(f"no reader for {kind}")
                    out += [(path, i, t or stem, x, md5, n, s, None) for i, (t, x, n, s) in enumerate(found, 1)]
                except Exception as e:  # a broken file is reported, not raised
                    out.append((path, None, None, None, md5, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"record_index": "Int32", "row_number": "Int32"})

    others = files.filter("doc_type <> '.pdf'").select("path", "content", "md5", "doc_type").mapInPandas(run, SCHEMA)
    raw = pdf.extract(files.filter("doc_type = '.pdf'"), pages)
    sums = files.filter("doc_type = '.pdf'").select(F.col("path").alias("source_path"), "md5")
    good = pdf.page_records(raw.filter("error IS NULL")).withColumn("record_index", F.row_number().over(Window.partitionBy("source_path").orderBy("page_number")))
    paged = good.unionByName(raw.filter("error IS NOT NULL").select("source_path", "error"), allowMissingColumns=True).join(sums, "source_path", "left")
    return others.unionByName(paged, allowMissingColumns=True)


def documents(records: DataFrame) -> DataFrame:
    """Records with text as documents: doc_id (file name and record), title, source_path, text, doc_type, metadata, and
    page_number and page_heading of PDF pages."""
    base = F.url_decode(F.element_at(F.split("source_path", "/"), -1))
    stem, suffix = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", ""), F.lower(F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1))
    text = F.expr(T.strip("coalesce(text, '')"))
    rows = records.filter("error IS NULL").withColumn("text", text).filter("text <> ''")
    return rows.select(
        F.concat(stem, F.lit("-"), F.col("record_index").cast("string")).alias("doc_id"), F.coalesce(F.nullif("title", F.lit("")), stem).alias("title"), "source_path", "text",
        suffix.alias("doc_type"), F.struct("md5", "page_number", "page_heading", "row_number", "source_type").alias("metadata"), "page_number", "page_heading",
    )
