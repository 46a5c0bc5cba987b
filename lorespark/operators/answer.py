"""From ranked chunks to contexts and extractive answers."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.config import HINTS, SETTINGS
from lorespark.functions import text as T

#: Texts of answers.
HEADER, MORE, CLOSING, ONLY = (
    "根据知识库里的资料，先给你一个简要结论：\n", "\n\n补充依据：\n",
    "\n\n如果你想要更聚焦的解释，可以继续补充 lecture 编号、章节标题、公式、算法名或关键词。", "根据已检索资料，最相关的信息是：\n",
)
ANSWERS = {
    "validation": "请输入一个具体问题，例如“为什么文本数据通常使用余弦相似度？”",
    "empty_index": "当前用户的资料库还是空的。先上传课程资料，再进行提问。",
    "no_context": "知识库里暂时没有足够相关的课程资料。你可以换一种问法，或者补充 lecture、章节、公式名或方法名。",
}


def merged_questions(x: str) -> str:
    """A short sentence that asks is joined with the one after it."""
    step = "IF(a.q <> '', named_struct('o', array_append(a.o, concat(a.q, ' ', s)), 'q', ''), IF(length(s) <= 36 AND s RLIKE '[？?]\\\\z', named_struct('o', a.o, 'q', s), named_struct('o', array_append(a.o, s), 'q', '')))"
    return f"aggregate({x}, named_struct('o', CAST(array() AS array<string>), 'q', ''), (a, s) -> {step}, a -> IF(a.q = '', a.o, array_append(a.o, a.q)))"


def ranked_sentences(hits: DataFrame, keep: int = 4) -> DataFrame:
    """hits (query_id, question, rank, score, text): the best sentences (query_id, place, sentence, value)."""
    rows = hits.select("query_id", "rank", "score", F.expr(f"array_distinct({T.tokens('question')})").alias("q"), F.posexplode(F.expr(merged_questions(T.answer_sentences("text")))).alias("pos", "sentence"))
    rows = rows.withColumn("s", F.expr(f"array_distinct({T.tokens('sentence')})")).withColumn("both", F.size(F.array_intersect("q", "s")))
    rows = rows.filter("both > 0 AND length(sentence) >= 12").filter(~F.col("sentence").rlike("|".join(HINTS)))
    rows = rows.withColumn("value", F.round(1.6 * F.col("both") + F.col("both") / F.size("s") + 0.15 * F.col("score"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("value"), "rank", "pos")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select("query_id", "place", "sentence", "value")


def packed_context(hits: DataFrame, most: int = SETTINGS.max_context_chars) -> DataFrame:
    """hits (query_id, rank, title, source_path, text): (query_id, context) of the first blocks that fit."""
    said = lambda c: F.coalesce(c, F.lit(""))
    block = F.concat(F.lit("[来源] "), said(F.col("title")), F.lit("\n[路径] "), said(F.col("source_path")), F.lit("\n[内容] "), said(F.expr(T.strip("text"))), F.lit("\n"))
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.select("query_id", "rank", block.alias("block")).withColumn("total", F.sum(F.length("block")).over(run)).filter(F.col("total") <= most)
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("bs"))
    return packed.select("query_id", F.expr("array_join(transform(bs, b -> b.block), '\\n')").alias("context"))


def sources(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, title, source_path, score, text, section_heading; metadata, page_number and page_heading
    where they are known): (query_id, rank, source), what an answer says of each hit."""
    have = lambda c, kind: F.col(c) if c in hits.columns else F.lit(None).cast(kind)
    source = F.struct(
        "title", F.col("source_path").alias("path"), F.round("score", 3).alias("score"), F.expr(T.strip("substring(text, 1, 320)")).alias("snippet"), have("metadata", "string").alias("metadata"),
        have("page_number", "int").alias("page_number"), have("section_heading", "string").alias("section_heading"), have("page_heading", "string").alias("page_heading"),
    )
    return hits.select("query_id", "rank", source.alias("source"))


def answers(questions: DataFrame, hits: DataFrame, empty: bool = False) -> DataFrame:
    """questions (query_id, question), hits of the same with rank, score and text: (query_id, question, mode, answer).
    empty: the index has no chunks. A blank question, or any one put to an empty index, isn't repeated."""
    best = ranked_sentences(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("ss"))
    best = best.select("query_id", F.expr("array_distinct(transform(ss, s -> s.sentence))").alias("ss"))
    first = hits.filter("rank = 1").select("query_id", F.expr(f"coalesce({T.strip('substring(text, 1, 280)')}, '')").alias("primary"))
    rows = questions.withColumn("question", F.expr(f"coalesce({T.strip('question')}, '')")).join(first, "query_id", "left").join(best, "query_id", "left")
    more = F.when(F.size("ss") > 2, F.concat(F.lit(MORE), F.expr("array_join(transform(slice(ss, 3, 99), s -> concat('- ', s)), '\\n')"))).otherwise("")
    text = F.when(F.col("ss").isNotNull(), F.concat(F.lit(HEADER), F.expr("array_join(slice(ss, 1, 2), '\\n')"), more, F.lit(CLOSING))).otherwise(F.concat(F.lit(ONLY), "primary"))
    mode = F.when(F.col("question") == "", "validation").when(F.lit(empty), "empty_index").when(F.col("primary").isNull(), "no_context").otherwise("local_summary")
    rows = rows.withColumn("mode", mode)
    fixed = F.create_map(*[F.lit(x) for kv in ANSWERS.items() for x in kv])
    return rows.select("query_id", F.when(~F.col("mode").isin("validation", "empty_index"), F.col("question")).alias("question"), "mode", F.when(F.col("mode") == "local_summary", text).otherwise(fixed[F.col("mode")]).alias("answer"))
