"""PDF pages: text extraction (with the pypdf package, where it is installed) and records made of pages."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import pdf as P


def pypdf_pages(data: bytes) -> list[str]:
    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def extract(files: DataFrame, reader: Callable[[bytes], list[str]] = pypdf_pages) -> DataFrame:
    """files (path, content): (source_path, page_number from 1, raw, error). A file that the reader fails on, or any
    file where the package is missing, gives one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, data in zip(frame.path, frame.content):
                try:
                    out += [(path, n, raw, None) for n, raw in enumerate(reader(data), 1)]
                except Exception as e:  # a broken file is reported, not raised
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source_path", "page_number", "raw", "error"]).astype({"page_number": "Int32"})

    return files.select("path", "content").mapInPandas(run, "source_path string, page_number int, raw string, error string")


def page_records(pages: DataFrame, markers: tuple[str, ...] = P.MARKERS) -> DataFrame:
    """pages (source_path, page_number, raw): one record a page whose clean text has 40 characters or more. Pages
    without text give none."""
    rows = pages.select("source_path", "page_number", F.expr(P.blocks("raw", "page_number", markers)).alias("bs"))
    rows = rows.select("source_path", "page_number", F.expr("array_join(bs, '\\n\\n')").alias("text"), F.expr(P.first_heading("bs")).alias("page_heading"))
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split("source_path", "/"), -1)), r"(?<=.)\.[^.]+$", "")
    title = F.concat(stem, F.lit(" p."), F.col("page_number").cast("string"))
    return rows.filter("length(text) >= 40").select("source_path", "page_number", title.alias("title"), "text", "page_heading", F.lit("pdf_page").alias("source_type"))
