import corpus_pipeline as C
from test_tokens import expected

from lorespark.llm import mixing as M
from lorespark.llm import wavelet as W
from lorespark.llm.common import in_order
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def in_shards(training):
    return sorted(map(tuple, W.read_shards(*training).collect()), key=lambda r: r[1])


def by_position(docs):
    """(doc_id, text) in training order, by the positions themselves."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("src"), M.size_of(F.col("text")).alias("size"))
    out = []
    for r in M.mixed(rows).collect():
        out += [(p, r.id, r.row.text) for p, n in ((r.position_1, r.taken_1), (r.position_2, r.taken_2)) if 2 * n >= r["size"] > 0]
    return [x[1:] for x in sorted(out)]


def test_shards_follow_the_curriculum(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = by_position(docs)
    assert [i for i, _ in want] != sorted(i for i, _ in want) and len({i for i, _ in want}) < len(want)
    mixed = C.stored(C.mix_sources(spark, docs, DIR), "mixed")
    out = C.token_output(spark, mixed, DIR)
    assert in_shards(out._lorespark_shards) == expected(want)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == expected(want)
    assert in_shards(W.training_output(M.curriculum(docs))._lorespark_shards) == expected(want)


def test_run_keeps_the_training_shards(spark):
    out = C.run(spark, DIR)
    got = in_shards(out._lorespark_shards)
    ids = [r[0] for r in got]
    assert got == sorted(map(tuple, out.collect()), key=lambda r: r[1]) and ids != sorted(ids)


def test_order_of_files_and_equal_shards(spark, tmp_path):
    # files of very different sizes, which a scan deals by size; the same document alone in several shards
    rows = [(i * 7 % 5, f"t{i * 7 % 5} " * (1 + i * 13 % 40) if i % 3 else "same") for i in range(60)]
    spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, doc_id long, text string").repartitionByRange(12, "n").sortWithinPartitions("n").drop("n").write.parquet(str(tmp_path / "d"))
    docs = in_order(spark.read.parquet(str(tmp_path / "d")), "o")
    m = W.write_shards(docs, str(tmp_path / "s"), shard=2, order="o")
    assert in_shards((m, str(tmp_path / "s"))) == expected(rows)
    assert W.training_output(spark.createDataFrame([], "doc_id long, text string")).count() == 0
