"""Rules of names, sizes, snippets and users, on rows worked out by hand."""

import pytest
from lorespark import config
from lorespark.functions import present as P
from lorespark.operators import answer, search, store
from lorespark.sources import files, legacy, uploads
from pyspark.sql import functions as F


def values(spark, rule, xs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(F.expr(rule("x"))).collect()]


def test_upload_names(spark):
    cases = {
        "K-Means++ 的初始化 émile": "K-Means_ 的初始化 _mile", "user_01@x": "user_01_x", "bad name!": "bad name", "## 1. Foo": "1. foo", "报告<1>?.MD": "报告_1.md", "...": "course_material",
        "C:/tmp/a b.md": "a b.md", "a/b/": "b", ".": "course_material", "..": "course_material", "a/.": "a", ".bashrc": "bashrc", "x.": "x", " a\x00b.TXT ": "ab.txt", "": "course_material", None: "course_material",
    }
    assert values(spark, P.upload_name, cases) == list(cases.values())


def test_sizes(spark):
    cases = {None: "0 B", -3: "0 B", 0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB", 10239: "10.0 KB", 10240: "10 KB", 15360: "15 KB", 10752: "11 KB", 5 << 20: "5.0 MB", 3 << 40: "3072 GB"}
    assert values(spark, P.file_size, cases, "long") == list(cases.values())


def test_snippets_and_links(spark):
    assert values(spark, P.truncated, ["  a \n\t b\u3000", "x" * 88, "x" * 89, None]) == ["a b", "x" * 88, "x" * 87 + "…", ""]
    assert values(spark, P.source_snippet, ["\n ]\n\\]\r\n  body <b>x</b>&nbsp;y\n\n", "]\n]", "a\n]", "", "<p>\n] c"]) == ["body x y", "", "a\n]", "", "] c"]
    rows = spark.createDataFrame([("a b/é(1)!.PDF", 3), ("x.md", 3), ("", 1), (None, 1), ("y.pdf", 0)], "p string, n int")
    assert [r[0] for r in rows.select(F.expr(P.source_link("p", "n"))).collect()] == ["/api/source?path=a%20b%2F%C3%A9(1)!.PDF#page=3", "/api/source?path=x.md", "", "", "/api/source?path=y.pdf"]


def test_answers_of_all_modes(spark):
    asked = spark.createDataFrame([(1, " "), (2, "q"), (3, None), (4, " alpha beta ")], "query_id long, question string")
    hits = spark.createDataFrame([(4, "alpha beta", 1, 2.0, " said elsewhere ", None, "p")], "query_id long, question string, rank int, score double, text string, title string, source_path string")
    got = {r.query_id: (r.question, r.mode, r.answer) for r in answer.answers(asked, hits).collect()}
    assert got[1] == got[3] == (None, "validation", answer.ANSWERS["validation"]) and got[2] == ("q", "no_context", answer.ANSWERS["no_context"])
    assert got[4] == ("alpha beta", "local_summary", answer.ONLY + "said elsewhere")
    assert {r.query_id: (r.question, r.mode) for r in answer.answers(asked, hits.limit(0), empty=True).collect()} == {1: (None, "validation"), 2: (None, "empty_index"), 3: (None, "validation"), 4: (None, "empty_index")}
    assert answer.packed_context(hits).first().context == "[来源] \n[路径] p\n[内容] said elsewhere\n"


def test_scores_of_zero_and_saved_indexes(spark, tmp_path):
    rows = [(i, f"t{i}", "head" if i == 7 else "", f"alpha w{i}" if i in (5, 9) else f"w{i}") for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_sk long, title string, heading string, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, ""), (3, "head w3 t1")], "query_id long, text string")
    tidy = lambda df: sorted((r.query_id, r["rank"], r.chunk_sk, r.score, r.heading_hits) for r in df.collect())
    got = tidy(search.search(search.build_index(chunks), asked, min_score=0))
    assert [x[2] for x in got if x[0] == 1] == [5, 9, 0, 1] and not [x for x in got if x[0] == 2] and [x[2] for x in got if x[0] == 3] == [1, 7, 3, 10]
    search.save_index(chunks, str(tmp_path / "v1"))
    opened = search.open_index(spark, str(tmp_path / "v1"))
    for least in (0.1, 0):
        assert tidy(search.search(opened, asked, min_score=least)) == tidy(search.search(search.build_index(chunks), asked, min_score=least))
    built = search.build_index(chunks)
    for a, b in ((opened.postings, built.postings), (opened.frequencies, built.frequencies), (opened.corpus, built.corpus)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_new_users_and_their_rows(spark):
    users = spark.createDataFrame([(1, "Ann"), (2, "bob")], "id long, username string")
    new = spark.createDataFrame([(1, " ann ", "secret1"), (2, "x", "secret1"), (3, "", "secret1"), (4, "eve", "short"), (5, "eve", "longer"), (6, "EVE", "longer"), (7, "张三", "longer"), (8, None, None)], "nr int, username string, password string")
    got = {r.nr: r.message for r in store.registered(users, new).collect()}
    assert got == {1: store.TAKEN, 2: store.BAD_NAME, 3: store.NO_NAME, 4: store.SHORT, 5: store.DONE, 6: store.TAKEN, 7: store.DONE, 8: store.NO_NAME}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "user_id long, v string")
    assert sorted(r.v for r in store.of_user(users, rows, " ANN ").collect()) == ["a", "c"] and store.of_user(users, rows, " ").count() == 0
    ids = store.record_ids(spark.sql("SELECT timestamp '2024-03-05 01:02:03.9' AS at UNION ALL SELECT timestamp '2024-03-05 01:02:03'"), "at").collect()
    assert all(len(r.record_id) == 23 and r.record_id.startswith("20240305010203-") for r in ids) and ids[0].record_id != ids[1].record_id


def test_first_of_new_rows_stays(spark):
    old = spark.createDataFrame([("a", 0)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, store.insert_ignore(old, new, "k", "v").collect())) == [("a", 0), ("b", 2), ("c", 4)]


def test_uploads(spark, tmp_path):
    new = spark.createDataFrame([("u", 1, "a.md"), ("u", 2, "a.md"), ("u", 3, "a-1.md"), ("v", 1, "x/a!.md")], "folder string, nr int, name string")
    there = spark.createDataFrame([("u", "a.md")], "folder string, name string")
    assert sorted((r.folder, r.nr, r.stored_as) for r in uploads.unique_names(new, there).collect()) == [("u", 1, "a-1.md"), ("u", 2, "a-2.md"), ("u", 3, "a-1-1.md"), ("v", 1, "a.md")]
    at = f"file://{tmp_path}/up"
    assert uploads.save_uploads(spark, at, [("n.md", b"one"), ("n.md", b"two")]) == ["n.md", "n-1.md"]
    with pytest.raises(ValueError):
        uploads.save_uploads(spark, at, [("ok.md", b""), ("no.exe", b"")])
    assert sorted(p.name for p in (tmp_path / "up").glob("[!.]*")) == ["n-1.md", "n.md"] and (tmp_path / "up" / "n-1.md").read_bytes() == b"two"
    assert uploads.seed(spark, at, f"file://{tmp_path}/new") == 2 and uploads.seed(spark, at, f"file://{tmp_path}/new") == 0
    uploads.delete_file(spark, at, "n.md")
    for path, error in (("n.md", FileNotFoundError), ("../new/n.md", PermissionError), ("", PermissionError), ("n-1.txt", PermissionError)):
        with pytest.raises(error):
            uploads.delete_file(spark, at, path)


def test_folders_and_pdf_pages(spark, tmp_path):
    assert files.scan(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / ".md").write_text("hidden")
    (tmp_path / "b.pdf").write_bytes(b"x")
    (tmp_path / "a.md").write_text("Hello world, this is text")
    scanned = files.scan(spark, f"file://{tmp_path}", (".md", ".PDF"))
    assert [r.path.rsplit("/", 1)[1] for r in scanned.collect()] == ["a.md", "b.pdf"]
    assert {(r.name, r.title, r.size_bytes) for r in files.listing(scanned).collect()} == {("a.md", "a", 25), ("b.pdf", "b", 1)}
    pages = lambda data: ["Heading here\nThis is a long enough paragraph of text, which ends here.", "", "Another one\nand once more a paragraph that is long enough."]
    docs = {r.doc_id: r for r in files.documents(files.load_records(scanned, pages)).collect()}
    assert sorted(docs) == ["a-1", "b-1", "b-2"] and docs["b-2"].page_number == 3 and docs["b-1"].page_heading == "Heading here" and docs["a-1"].metadata.md5 and docs["b-1"].metadata.md5
    bad = files.load_records(scanned, lambda data: 1 / 0).filter("error IS NOT NULL").collect()
    assert len(bad) == 1 and "ZeroDivision" in bad[0].error
    from lorespark.operators import chunking

    chunks = {r.doc_id: r for r in chunking.chunk_documents(files.documents(files.load_records(scanned, pages))).collect()}
    assert chunks["b-1"].section_heading == "Heading here" and chunks["b-1"].page_number == 1 and chunks["a-1"].metadata.md5


def test_old_history(spark, tmp_path):
    (tmp_path / "history.json").write_text('{"history": {"me": [{"id": "1", "question": "q", "sources": [{"title": "t", "path": " old/a.md ", "score": 1.25, "page_number": 2}, {"path": "other.md"}], "created_at": "2024-01-02T03:04:05"}], "you": [{"id": "2"}]}}')
    rows = legacy.history(spark, f"file://{tmp_path}", "me", moved={"old/a.md": "mine/a.md"}).select("*", F.date_format(F.to_utc_timestamp("created_at", "UTC"), "HH:mm:ss").alias("at")).collect()
    assert len(rows) == 1 and rows[0].at == "03:04:05"
    assert rows[0].sources_json == '[{"title":"t","path":"mine/a.md","score":1.25,"page_number":2},{"path":"other.md"}]'


def test_settings(tmp_path):
    assert config.settings({"top_k": 9, "other": 1}).top_k == 9 and config.settings() == config.SETTINGS
    with pytest.raises(ValueError):
        config.settings(["top_k"])
    (tmp_path / ".env").write_text("# no\nA = '1'\n\nB=x=y\nnothing\n")
    assert config.environment(str(tmp_path / ".env"), {"A": "0", "C": "2"}) == {"A": "1", "B": "x=y", "C": "2"}
    assert config.environment(str(tmp_path / "none"), {"A": "0"}) == {"A": "0"}
