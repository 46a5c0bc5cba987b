import json

from lorespark.functions import pdf as P
from lorespark.operators import remote
from lorespark.sources import legacy, pdf
from lorespark.streaming import refresh
from pyspark.sql import functions as F


def test_repair_joins_cut_letters(spark):
    cases = {
        "C lustering  of data": "Clustering of data", "A b c word": "Abcword", "A B c word": "A Bcword", "x 1 ab": "x 1 ab",
        "end . And , so": "end. And, so", "a bc de": "abc de", "a b": "a b", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", F.expr(P.repaired("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_noise(spark):
    noise = ["", "12", "iv", "7", "https://a.b", "[3] http://x", "Department of Computing", "p. 4", "12 / 30", "COMP 5575 week", "mix"]
    kept = ["A heading", "page 12 of notes", "a", "xvii", "see https://a.b"]
    df = spark.createDataFrame([(x,) for x in noise + kept], "x string")
    found = {r.x for r in df.filter(F.expr(P.is_noise("x", "12"))).collect()}
    assert found == set(noise)


def test_pages(spark):
    raw = "3\nThe title\r\n- first item that goes\non in the next line.\nOne paragraph that ends here.\nIt has two lines.\n- b\x0cTail of it;"
    df = spark.createDataFrame([("d/a%20b.pdf", 3, raw), ("d/c.pdf", 1, "short"), ("d/c.pdf", 2, None)], "source_path string, page_number int, raw string")
    (r,) = pdf.page_records(df).collect()
    assert (r.title, r.page_heading, r.source_type) == ("a b p.3", "The title", "pdf_page")
    assert r.text == "The title\n\n- first item that goes on in the next line. One paragraph that ends here. It has two lines.\n\n- b Tail of it;"


def test_extraction_reports_failures(spark):
    def reader(data):
        if data == b"bad":
            raise ValueError("no")
        return data.decode().split("|")

    df = spark.createDataFrame([("a", b"one|two"), ("b", b"bad")], "path string, content binary")
    got = {(r.source_path, r.page_number, r.raw, r.error) for r in pdf.extract(df, reader).collect()}
    assert got == {("a", 1, "one", None), ("a", 2, "two", None), ("b", None, None, "ValueError: no")}


def test_import(spark, tmp_path):
    (tmp_path / "users.json").write_text(json.dumps({"users": {" ann ": {"password_hash": "h", "created_at": "2024-01-02T03:04:05Z"}, "": {}, "bob": {}}}))
    (tmp_path / "history.json").write_text(json.dumps({"history": {"ann": [{"id": "r1", "question": "q", "sources": [{"path": "p"}]}, {"id": "r1"}], "bob": [{"id": "r2"}]}}))
    (tmp_path / "broken.json").write_text("{")
    users = legacy.users(spark, f"file://{tmp_path}")
    assert {(r.username, r.password_hash) for r in users.collect()} == {("ann", "h"), ("bob", "")}
    assert str(users.filter("username = 'ann'").first().created_at) == "2024-01-02 03:04:05"
    rows = legacy.history(spark, f"file://{tmp_path}", "ann")
    assert rows.count() == 2 and {r.sources_json for r in rows.collect()} == {'[{"path":"p"}]', "[]"}
    assert legacy.imported(rows.limit(0), rows, "record_id").count() == 1 and legacy.imported(rows, rows, "record_id").count() == 2
    assert legacy.users(spark, f"file://{tmp_path}", "broken.json").count() == legacy.users(spark, f"file://{tmp_path}", "none.json").count() == 0


def test_remote_answers_fall_back(spark):
    def factory():
        def ask(system, user):
            if "two" in user:
                raise OSError
            return f"{system}:{user}"

        return ask

    asked = spark.createDataFrame([(1, "one {context}"), (2, "two"), (3, "three")], "query_id long, question string")
    contexts = spark.createDataFrame([(1, "c1 {question}"), (2, "c2")], "query_id long, context string")
    local = spark.createDataFrame([(i, "local_summary", "l") for i in (1, 2, 3)], "query_id long, mode string, answer string")
    out = remote.with_remote(local, remote.remote_answers(remote.prompts(asked, contexts, "Q {question} C {context}"), "s", factory))
    assert {tuple(r) for r in out.collect()} == {(1, "remote_llm", "s:Q one {context} C c1 {question}"), (2, "local_summary", "l"), (3, "local_summary", "l")}


def test_refresh_sees_the_whole_folder(spark, tmp_path):
    seen, data = [], tmp_path / "in"
    data.mkdir()
    for name in ("a.md", "b.md"):
        (data / name).write_text("x")
        refresh.refresh(spark, f"file://{data}", f"file://{tmp_path}/cp", lambda df: seen.append(df.count())).awaitTermination()
    refresh.refresh(spark, f"file://{data}", f"file://{tmp_path}/cp", lambda df: seen.append(-1)).awaitTermination()
    assert seen == [1, 2]
