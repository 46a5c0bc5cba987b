import re

from lorespark.functions import text as T
from lorespark.operators import answer, chunking
from lorespark.sources import files
from pyspark.sql import functions as F


def chunked(spark, *texts, **k):
    df = spark.createDataFrame([(i, "t", f"p/{i}", x) for i, x in enumerate(texts)], "doc_id int, title string, source_path string, text string")
    return [(r.doc_id, r.text) for r in chunking.chunk_documents(df, **k).orderBy("doc_id", "order").collect()]


def sentence(n, c="a"):
    return (c * 9 + " ") * (n // 10 - 1) + c * (n - 10 * (n // 10 - 1) - 1) + "."


def test_long_segments(spark):
    s50, s600 = sentence(50), sentence(600, "b")
    assert [len(t) for _, t in chunked(spark, f"{s50} {s600}")] == [50, 600]
    assert [len(t) for _, t in chunked(spark, f"{s600} {s50}")] == [419, 260, 50]
    assert [len(t) for _, t in chunked(spark, "x" * 760)] == [420, 420, 80]
    assert all("# T" not in t for _, t in chunked(spark, "# T\n\n" + s600 + " " + s50))


def test_brief_texts_and_overlap(spark):
    assert chunked(spark, "Hello world", "Hi all", "  ") == [(0, "Hello world")]
    paras = [sentence(200, c) for c in "abcd"]
    got = [t for _, t in chunked(spark, "\n\n".join(paras))]
    assert got[0] == "\n\n".join(paras[:2]) and got[1] == "\n\n".join(paras[1:3]) and got[2] == "\n\n".join(paras[2:4])


def test_windows_of_documents_hold_the_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lit("t").alias("title"), F.lit("p").alias("source_path"), "text")
    rows = chunking.chunk_documents(docs).collect()
    assert rows and all(r.text and len(re.sub(r"[\W_]", "", r.text)) >= 6 for r in rows)
    assert {(r.doc_id, r.order) for r in rows} == {(r.doc_id, i + 1) for r in rows for i in range(sum(x.doc_id == r.doc_id for x in rows))}


def test_question_merge_and_context(spark):
    df = spark.createDataFrame([("是什么？这是一个很长的回答句子。尾",)], "t string")
    assert df.select(F.expr(answer.merged_questions(T.answer_sentences("t")))).first()[0] == ["是什么？ 这是一个很长的回答句子。", "尾"]
    hits = spark.createDataFrame([(1, i + 1, "t", "p", "x" * n) for i, n in enumerate([1500, 900, 100])], "query_id int, rank int, title string, source_path string, text string")
    assert answer.packed_context(hits).first().context.count("[来源]") == 1


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a b.MD").write_bytes("\n# x\r\ny\rz\n".encode())
    (tmp_path / "c.csv").write_bytes("﻿a,b\n1,\n2,3\n".encode())
    (tmp_path / "bad.csv").write_bytes(b"a\n1,2\n")
    (tmp_path / "~$l.md").write_bytes(b"no")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:document>')
    got = {(r.title, r.text, r.row_number, bool(r.error)) for r in files.load_records(files.scan(spark, f"file://{tmp_path}", (".md", ".csv", ".docx"))).collect()}
    assert got == {("a b", "# x\ny\nz", None, False), ("c.csv 第 1 行", "a: 1", 1, False), ("c.csv 第 2 行", "a: 2\nb: 3", 2, False), (None, None, None, True), ("d", "one two\n\nthree", None, False)}
