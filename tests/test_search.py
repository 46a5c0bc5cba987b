"""Rules of search and answers that the synthetic tables don't reach."""

from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import answer, search

CHUNKS = [
    (1, "Lecture 3", "", "k-means groups points around centres"),
    (2, "notes", "k-means", "nothing of that kind is said here"),
    (3, "机器学习聚类", "", "聚类 把相似的点放在一起"),
    (4, None, None, None),
    (5, "x", "", ""),
]


def found(spark, questions, **options):
    chunks = spark.createDataFrame(CHUNKS, "chunk_sk long, title string, heading string, text string")
    asked = spark.createDataFrame(questions, "query_id long, text string")
    rows = search.search(search.build_index(chunks), asked, **options).orderBy("query_id", "rank").collect()
    return [(r.query_id, r.chunk_sk, r.heading_hits) for r in rows], {(r.query_id, r.chunk_sk): r.score for r in rows}


def test_part_of_a_title_is_enough(spark):
    rows, score = found(spark, [(1, "lect")])
    assert rows == [(1, 1, 0)] and score[1, 1] == 0.45


def test_heading_hits_come_before_scores(spark):
    rows, _ = found(spark, [(1, "k-means centres points")])
    assert rows[:2] == [(1, 2, 1), (1, 1, 0)]


def test_penalty_without_ascii_hits(spark):
    _, plain = found(spark, [(1, "聚类")])
    _, both = found(spark, [(1, "zebra 聚类")])
    boosts = 0.9 + 0.45  # 聚类 is a heading token through the title, and part of it
    assert abs((plain[1, 3] - boosts) * 0.35 - (both[1, 3] - boosts)) < 2e-6


def test_blank_questions_and_empty_tables(spark):
    assert found(spark, [(1, ""), (2, None), (3, "zebra")])[0] == []
    assert found(spark, [])[0] == []


def test_title_parts_are_all_substrings_of_runs(spark):
    got = spark.range(1).select(F.expr(search.title_parts("'ab-c 机器学'", 3))).first()[0]
    assert sorted(got) == sorted(["ab", "ab-", "b-", "b-c", "-c", "机器", "器学"])


def test_short_questions_join_the_next_sentence(spark):
    cases = [["a?", "b", "c"], ["a?", "b?", "c?", "d"], ["a", "b?"], [], ["x" * 40 + "?", "b"]]
    want = [["a? b", "c"], ["a? b?", "c? d"], ["a", "b?"], [], ["x" * 40 + "?", "b"]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>")
    assert [r[0] for r in rows.orderBy("i").select(F.expr(answer.merged_questions("s"))).collect()] == want


def test_answer_sentences_are_cut_after_chinese_marks(spark):
    assert spark.range(1).select(F.expr(T.answer_sentences("'一。二？ 三\\n four. five'"))).first()[0] == ["一。", "二？", "三", "four. five"]
