from lorespark.plans import catalog as C


def test_keys_of_long_documents_stay_apart(spark, monkeypatch):
    rows = [(1, 100_001, "t", "", "alpha beta"), (2, 1, "t", "", "gamma delta"), (2, 2, "t", "", "other words")]
    chunks = spark.createDataFrame(rows, "doc_id long, order int, title string, section_heading string, text string")
    monkeypatch.setattr(C, "titled", lambda spark, d: None)
    monkeypatch.setattr(C.chunking, "chunk_documents", lambda docs: chunks)
    monkeypatch.setattr(C, "asked", lambda spark, d: spark.createDataFrame([(7, "alpha gamma")], "query_id long, text string"))
    got = [((r.doc_id, r["order"]), r["rank"]) for r in C.bm25_over_chunks(spark, "").collect()]
    assert sorted(got, key=lambda r: r[1]) == [((1, 100_001), 1), ((2, 1), 2)]
