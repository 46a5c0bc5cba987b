"""All queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import present as P
from lorespark.functions import text as T
from lorespark.operators import answer, chunking, search, store

QUERIES: dict = {}
ORACLE: dict = {}
TITLE = "array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ')"
TOK = r"regexp_extract_all(lower({0}), '[a-z0-9_+\-]+')"
STRIP = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+\z', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table of texts that a task gets at most.
TASK = 32 << 20


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is heavy on each text: a table of fewer files than cores, or of large ones, is dealt to all
    of them in tasks of TASK bytes of it."""
    docs, cores = read(spark, sf_dir, "documents").select("doc_id", "text", "source"), spark.sparkContext.defaultParallelism
    files, tasks = len(docs.inputFiles()), -(-search.input_bytes(docs) // TASK)
    return docs if files >= max(cores, tasks) else docs.repartition(max(4 * cores, tasks))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: title of three words, no heading."""
    d = texts(spark, sf_dir)
    return d.select(F.col("doc_id").alias("chunk_sk"), F.substring_index("text", " ", 3).alias("title"), F.lit("").alias("heading"), "text", "source")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


INDEX_SQL = f"""
docs AS (SELECT doc_id AS chunk_sk, {TITLE} AS title, text, source FROM documents),
tok AS (SELECT chunk_sk, unnest({TOK.format('text')}) AS token FROM docs),
post AS (SELECT chunk_sk, token, count(*) AS tf FROM tok GROUP BY ALL),
freq AS (SELECT token, count(*) AS df FROM post GROUP BY token),
st AS (SELECT chunk_sk, len({TOK.format('text')}) AS dl, list_distinct({TOK.format('title')}) AS ht, lower(title) AS title_lc FROM docs),
cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM st),
q AS (SELECT item_id AS query_id, unnest(list_distinct({TOK.format('text')})) AS token FROM benchmark)"""


def bm25_sql(adjust: bool = True, heading: float = 0.9, title: float = 0.45, least: float = 0.1, k: int = 4) -> str:
    adj = "CASE WHEN na = 0 THEN b WHEN hits = 0 THEN b * 0.35 ELSE b + 0.75 * hits END" if adjust else "b"
    return f"""WITH {INDEX_SQL},
body AS (SELECT query_id, chunk_sk, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / greatest(avgdl, 1.0)))) AS bm, sum(CASE WHEN len(token) >= 3 THEN 1 ELSE 0 END) AS hits
  FROM q JOIN post USING (token) JOIN freq USING (token) JOIN st USING (chunk_sk), cs GROUP BY ALL),
hd AS (SELECT query_id, chunk_sk, count(*) AS hh FROM (SELECT chunk_sk, unnest(ht) AS token FROM st) JOIN q USING (token) GROUP BY ALL),
tt AS (SELECT DISTINCT query_id, chunk_sk, 1 AS t FROM st JOIN q ON len(token) > 1 AND contains(title_lc, token)),
na AS (SELECT query_id, sum(CASE WHEN len(token) >= 3 THEN 1 ELSE 0 END) AS na FROM q GROUP BY query_id),
s AS (SELECT query_id, chunk_sk, coalesce(bm, 0.0) AS b, coalesce(hits, 0) AS hits, coalesce(hh, 0)::INT AS heading_hits, coalesce(t, 0) AS t FROM body FULL JOIN hd USING (query_id, chunk_sk) FULL JOIN tt USING (query_id, chunk_sk)),
r AS (SELECT query_id, chunk_sk, round({adj} + {heading} * heading_hits + {title} * t, 6) AS score, heading_hits FROM s JOIN na USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY heading_hits DESC, score DESC, chunk_sk)::INT AS rank FROM r WHERE score >= {least}),
top AS (SELECT query_id, chunk_sk, score, heading_hits, rank FROM ranked WHERE rank <= {k})"""


@query("bm25_topk", bm25_sql() + " SELECT * FROM top")
def bm25_topk(spark, d):
    return search.search(search.build_index(corpus(spark, d)), asked(spark, d))


@query("bm25_unadjusted", bm25_sql(adjust=False) + " SELECT * FROM top")
def bm25_unadjusted(spark, d):
    return search.search(search.build_index(corpus(spark, d)), asked(spark, d), adjust=False)


@query("bm25_min_score", bm25_sql(least=60, k=10) + " SELECT * FROM top")
def bm25_min_score(spark, d):
    return search.search(search.build_index(corpus(spark, d)), asked(spark, d), k=10, min_score=60)


@query("bm25_title_boost", bm25_sql(title=5.0) + " SELECT * FROM top")
def bm25_title_boost(spark, d):
    return search.search(search.build_index(corpus(spark, d)), asked(spark, d), title_boost=5.0)


@query("owner_isolated_topk", bm25_sql().replace("FROM documents", "FROM documents WHERE source = 'src3'") + " SELECT * FROM top")
def owner_isolated_topk(spark, d):
    return search.search(search.build_index(corpus(spark, d).filter("source = 'src3'")), asked(spark, d))


@query("tokenize_documents", f"WITH {INDEX_SQL} SELECT doc_id, array_to_string({TOK.format('text')}, ' ') AS tokens FROM documents")
def tokenize_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", F.expr(f"array_join({T.tokens('text')}, ' ')").alias("tokens"))


@query("postings", f"WITH {INDEX_SQL} SELECT chunk_sk, token, tf FROM post")
def postings(spark, d):
    return search.build_index(corpus(spark, d)).postings


@query("document_frequency", f"WITH {INDEX_SQL} SELECT token, df FROM freq")
def document_frequency(spark, d):
    return search.build_index(corpus(spark, d)).frequencies


@query("chunk_stats", f"WITH {INDEX_SQL} SELECT chunk_sk, dl, array_to_string(list_sort(ht), ' ') AS heading_tokens, title_lc FROM st")
def chunk_stats(spark, d):
    return search.build_index(corpus(spark, d)).stats.withColumn("heading_tokens", F.array_join(F.sort_array("heading_tokens"), " "))


@query("corpus_stats", f"WITH {INDEX_SQL} SELECT n, round(avgdl, 6) AS avgdl FROM cs")
def corpus_stats(spark, d):
    return search.build_index(corpus(spark, d)).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("inverse_document_frequency", f"WITH {INDEX_SQL} SELECT token, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM freq, cs")
def inverse_document_frequency(spark, d):
    i = search.build_index(corpus(spark, d))
    return i.frequencies.crossJoin(F.broadcast(i.corpus)).select("token", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def hits_of(spark, d):
    c = corpus(spark, d)
    found = search.search(search.build_index(c), asked(spark, d))
    # a few rows for each question, so that no text is dealt again
    rows = F.broadcast(found).join(c.select("chunk_sk", "title", "text", F.concat("source", F.lit("/"), F.col("chunk_sk").cast("string")).alias("source_path")), "chunk_sk")
    return rows.join(asked(spark, d).withColumnRenamed("text", "question"), "query_id")


HITS_SQL = bm25_sql() + """,
hits AS (SELECT top.*, title, d.text, source || '/' || d.chunk_sk AS source_path, b.text AS question FROM top JOIN docs AS d USING (chunk_sk) JOIN benchmark AS b ON b.item_id = query_id)"""
SENT_SQL = HITS_SQL + rf""",
sl AS (SELECT query_id, rank, score, list_distinct({TOK.format('question')}) AS qt, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ss FROM hits),
s1 AS (SELECT query_id, rank, score, qt, i, ss[i] AS s FROM sl, unnest(range(1, len(ss) + 1)) AS t(i)),
s2 AS (SELECT *, list_distinct({TOK.format('s')}) AS st_ FROM s1 WHERE len(s) >= 12),
s3 AS (SELECT *, len(list_intersect(qt, st_)) AS both_ FROM s2),
s4 AS (SELECT *, round(1.6 * both_ + both_ / len(st_) + 0.15 * score, 6) AS value FROM s3 WHERE both_ > 0),
s5 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, rank, i)::INT AS place, s AS sentence, value FROM s4),
best AS (SELECT * FROM s5 WHERE place <= 4)"""


@query("source_projection", HITS_SQL + f" SELECT query_id, rank, title, source_path, round(score, 3) AS score, {strip('substring(text, 1, 320)')} AS snippet FROM hits")
def source_projection(spark, d):
    return hits_of(spark, d).select("query_id", "rank", "title", "source_path", F.round("score", 3).alias("score"), F.expr(T.strip("substring(text, 1, 320)")).alias("snippet"))


@query("context_packing", HITS_SQL + f""", b AS (SELECT query_id, rank, '[来源] ' || coalesce(title, '') || chr(10) || '[路径] ' || coalesce(source_path, '') || chr(10) || '[内容] ' || {strip('text')} || chr(10) AS block FROM hits),
c AS (SELECT *, sum(len(block)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM b)
SELECT query_id, string_agg(block, chr(10) ORDER BY rank) AS context FROM c WHERE total <= 2200 GROUP BY query_id""")
def context_packing(spark, d):
    return answer.packed_context(hits_of(spark, d))


@query("sentence_ranking", SENT_SQL + " SELECT query_id, place, sentence, value FROM best")
def sentence_ranking(spark, d):
    return answer.ranked_sentences(hits_of(spark, d))


@query("answer_text", SENT_SQL + rf""",
u AS (SELECT query_id, sentence, min(place) AS place FROM best GROUP BY ALL),
v AS (SELECT query_id, list(sentence ORDER BY place) AS ss FROM u GROUP BY query_id)
SELECT b.item_id AS query_id, nullif(coalesce({strip('b.text')}, ''), '') AS question, CASE WHEN coalesce({strip('b.text')}, '') = '' THEN 'validation' WHEN h.text IS NULL THEN 'no_context' ELSE 'local_summary' END AS mode,
  CASE WHEN coalesce({strip('b.text')}, '') = '' THEN '请输入一个具体问题，例如“为什么文本数据通常使用余弦相似度？”' WHEN h.text IS NULL THEN '知识库里暂时没有足够相关的课程资料。你可以换一种问法，或者补充 lecture、章节、公式名或方法名。' WHEN ss IS NOT NULL THEN '{answer.HEADER.strip()}' || chr(10) || array_to_string(list_slice(ss, 1, 2), chr(10))
    || CASE WHEN len(ss) > 2 THEN chr(10) || chr(10) || '{answer.MORE.strip()}' || chr(10) || array_to_string(list_transform(list_slice(ss, 3, 99), lambda x: '- ' || x), chr(10)) ELSE '' END || chr(10) || chr(10) || '{answer.CLOSING.strip()}'
  ELSE '{answer.ONLY.strip()}' || chr(10) || {strip('substring(h.text, 1, 280)')} END AS answer
FROM benchmark AS b LEFT JOIN v ON v.query_id = b.item_id LEFT JOIN hits AS h ON h.query_id = b.item_id AND h.rank = 1""")
def answer_text(spark, d):
    return answer.answers(asked(spark, d).withColumnRenamed("text", "question"), hits_of(spark, d))


NORM = rf"regexp_replace(array_to_string(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace({strip('x')}, '[ \t]{{2,}}', ' ', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"
BULLET = r"'^(?:[-*•▪◦]|(?:\p{Nd}+|[A-Za-z])[.)])[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'"


@query("normalize_whitespace", f"SELECT doc_id, {strip(NORM)} AS text FROM documents")
def normalize_whitespace(spark, d):
    return read(spark, d, "documents").select("doc_id", F.expr(T.normalized("text")).alias("text"))


@query("line_kinds", rf"""WITH l AS (SELECT doc_id, i, {strip('string_split(text, chr(10))[i]')} AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i))
SELECT doc_id, (i - 1)::INT AS pos, regexp_matches(line, {BULLET}) AS bullet, (line LIKE '#%' OR (len(line) <= 90 AND NOT regexp_matches(line, {BULLET}) AND NOT regexp_matches(line, '[。？！.?!;；:]\z'))) AS heading FROM l""")
def line_kinds(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", F.expr(T.strip("line")))
    return rows.select("doc_id", "pos", F.expr(T.is_bullet("line")).alias("bullet"), F.expr(T.is_heading("line")).alias("heading"))


@query("segments", rf"""WITH l AS (SELECT doc_id, i, {strip("string_split(" + strip(NORM) + ", chr(10))[i]")} AS line FROM documents, unnest(range(1, len(string_split({strip(NORM)}, chr(10))) + 1)) AS t(i)),
k AS (SELECT *, regexp_matches(line, {BULLET}) OR line LIKE '#%' OR (len(line) <= 90 AND NOT regexp_matches(line, '[。？！.?!;；:]\z')) AS alone FROM l),
g AS (SELECT *, sum(CASE WHEN alone OR line = '' THEN 1 ELSE 0 END) OVER w + sum(CASE WHEN alone OR line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
s AS (SELECT doc_id, coalesce(grp, CASE WHEN alone THEN 1 ELSE 0 END) AS grp, string_agg(line, ' ' ORDER BY i) AS segment FROM g WHERE line <> '' GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INT AS pos, segment FROM s""")
def segments(spark, d):
    rows = texts(spark, d).select("doc_id", F.posexplode_outer(F.expr(chunking.segments("text"))).alias("pos", "segment"))
    return rows.filter("pos IS NOT NULL")


@query("sentence_split", rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?;；:])[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, (i - 1)::INT AS pos, ss[i] AS sentence FROM s, unnest(range(1, len(ss) + 1)) AS t(i)""")
def sentence_split(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.expr(T.sentences("text"))).alias("pos", "sentence"))


@query("answer_sentence_split", rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？；\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, (i - 1)::INT AS pos, ss[i] AS sentence FROM s, unnest(range(1, len(ss) + 1)) AS t(i)""")
def answer_sentence_split(spark, d):
    return texts(spark, d).select("doc_id", F.posexplode(F.expr(T.answer_sentences("text"))).alias("pos", "sentence"))


@query("question_merge", rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?;；:])[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS ss FROM documents),
e AS (SELECT doc_id, i, ss[i] AS s, len(ss[i]) <= 36 AND regexp_matches(ss[i], '[？?]\z') AS q FROM s, unnest(range(1, len(ss) + 1)) AS t(i)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS run FROM e),
m AS (SELECT *, q AND row_number() OVER (PARTITION BY doc_id, q, run ORDER BY i) % 2 = 1 AS first_ FROM r),
g AS (SELECT *, coalesce(lag(first_) OVER (PARTITION BY doc_id ORDER BY i), false) AS taken FROM m),
h AS (SELECT *, sum(CASE WHEN taken THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT doc_id, (grp - 1)::INT AS pos, string_agg(s, ' ' ORDER BY i) AS sentence FROM h GROUP BY doc_id, grp""")
def question_merge(spark, d):
    return texts(spark, d).select("doc_id", F.posexplode(F.expr(answer.merged_questions(T.sentences("text")))).alias("pos", "sentence"))


@query("sliding_windows", rf"""WITH w AS (SELECT doc_id, i, {strip('substring(text, i + 1, 420)')} AS piece FROM documents, unnest(range(0, len(text), 340)) AS t(i))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, piece FROM w WHERE piece <> ''""")
def sliding_windows(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.expr(T.windows("text", 420, 80))).alias("pos", "piece"))


@query("meaningful_lines", rf"""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)),
m AS (SELECT *, len({strip('line')}) AS n, len(regexp_replace(line, '[^\p{{L}}\p{{N}}]', '', 'g')) AS a FROM l)
SELECT doc_id, (i - 1)::INT AS pos, n >= 40 AND a >= greatest(18, n // 3) AS meaningful, n >= 8 AND a >= greatest(6, n // 2) AS brief FROM m""")
def meaningful_lines(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("doc_id", "pos", F.expr(T.meaningful("line")).alias("meaningful"), F.expr(T.brief("line")).alias("brief"))


def titled(spark, d):
    return texts(spark, d).select("doc_id", F.substring_index("text", " ", 3).alias("title"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_path"), "text")


def meaningful_sql(x: str, least: int, alnum: int, part: int) -> str:
    return rf"(len({strip(x)}) >= {least} AND len(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')) >= greatest({alnum}, len({strip(x)}) // {part}))"


def clean_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({strip(x)}, '^#{{1,6}}[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]*', ''), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '[ \t]{{2,}}', ' ', 'g'), '^[ \-–:：]+|[ \-–:：]+\z', '', 'g')"


def windows_sql(x: str) -> str:
    return f"list_filter(list_transform(range(0, len({x}), 340), lambda w: {strip(f'substring({x}, w + 1, 420)')}), lambda w: w <> '')"


#: Rules of the chunker, one segment a step: the state of a document is what has been packed (segs, cur) and what the
#: step gives out.
CHUNK_SQL = rf"""WITH RECURSIVE l AS (SELECT doc_id, i, {strip("string_split(" + strip(NORM) + ", chr(10))[i]")} AS line FROM documents, unnest(range(1, len(string_split({strip(NORM)}, chr(10))) + 1)) AS t(i)),
k AS (SELECT *, regexp_matches(line, {BULLET}) OR line LIKE '#%' OR (len(line) <= 90 AND NOT regexp_matches(line, '[。？！.?!;；:]\z')) AS alone FROM l),
g AS (SELECT *, sum(CASE WHEN alone OR line = '' THEN 1 ELSE 0 END) OVER w + coalesce(sum(CASE WHEN alone OR line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
sg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS pos, string_agg(line, ' ' ORDER BY i) AS sg FROM g WHERE line <> '' GROUP BY doc_id, grp),
sn AS (SELECT doc_id, pos, sg, list_filter(list_transform(string_split(regexp_replace(sg, '([。！？.!?;；:])[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS ss FROM sg WHERE len(sg) > 420),
lp AS (SELECT doc_id, pos, ss, 0 AS i, '' AS cur, []::VARCHAR[] AS o FROM sn WHERE len(ss) > 1 UNION ALL
  SELECT doc_id, pos, ss, i + 1, CASE WHEN len(cand) <= 420 THEN cand WHEN cur <> '' THEN s ELSE '' END,
    CASE WHEN len(cand) <= 420 THEN o WHEN cur <> '' THEN list_append(o, cur) ELSE list_concat(o, {windows_sql('s')}) END
  FROM (SELECT *, ss[i + 1] AS s, CASE WHEN cur = '' THEN ss[i + 1] ELSE {strip("(cur || ' ' || ss[i + 1])")} END AS cand FROM lp WHERE i < len(ss))),
pieces AS (SELECT doc_id, pos, CASE WHEN cur <> '' THEN list_append(o, cur) ELSE o END AS ps FROM lp WHERE i = len(ss) UNION ALL SELECT doc_id, pos, {windows_sql('sg')} FROM sn WHERE len(ss) <= 1),
sp AS (SELECT sg.doc_id, sg.pos, sg.sg, list_filter(ps, lambda x: {meaningful_sql('x', 40, 18, 3)}) AS ps FROM sg LEFT JOIN pieces USING (doc_id, pos)),
pk AS (SELECT doc_id, 0::BIGINT AS pos, []::VARCHAR[] AS segs, '' AS cur, []::VARCHAR[] AS given FROM documents UNION ALL
  SELECT doc_id, pos, CASE WHEN len(sg) > 420 THEN [] WHEN kept THEN list_append(segs, sg) ELSE list_append(seed, sg) END,
    CASE WHEN len(sg) > 420 THEN '' WHEN len(segs) = 0 THEN sg WHEN kept THEN cur || chr(10) || chr(10) || sg ELSE array_to_string(list_append(seed, sg), chr(10) || chr(10)) END,
    CASE WHEN kept THEN [] ELSE list_concat(CASE WHEN {meaningful_sql('cur', 40, 18, 3)} THEN [cur] ELSE []::VARCHAR[] END, CASE WHEN len(sg) > 420 THEN ps ELSE []::VARCHAR[] END) END
  FROM (SELECT pk.doc_id, sp.pos, pk.segs, pk.cur, sp.sg, sp.ps, len(sp.sg) <= 420 AND (len(pk.segs) = 0 OR len(pk.cur) + 2 + len(sp.sg) <= 420) AS kept,
    list_slice(pk.segs, len(pk.segs) + 1 - greatest(1, len(list_filter(range(1, len(pk.segs) + 1), lambda m: list_sum(list_transform(list_slice(pk.segs, len(pk.segs) + 1 - m, len(pk.segs)), lambda x: len(x) + 2)) <= 80))), len(pk.segs)) AS seed
    FROM pk JOIN sp ON sp.doc_id = pk.doc_id AND sp.pos = pk.pos + 1)),
final AS (SELECT doc_id, arg_max(cur, pos) AS cur, max(pos) + 1 AS pos FROM pk GROUP BY doc_id),
given AS (SELECT doc_id, pos, given FROM pk UNION ALL SELECT doc_id, pos, [cur] FROM final WHERE {meaningful_sql('cur', 40, 18, 3)}),
got_ AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) AS "order" FROM (SELECT doc_id, pos, i, given[i] AS text FROM given, unnest(range(1, len(given) + 1)) AS t(i))),
parts AS (SELECT * FROM got_ UNION ALL SELECT doc_id, whole, 1 FROM (SELECT doc_id, {strip(NORM)} AS whole FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM got_)) WHERE {meaningful_sql('whole', 8, 6, 2)}),
hl AS (SELECT doc_id, "order", text, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), lambda x: {{'s': x, 'c': {clean_sql('x')}}}), lambda x: x.c <> '' AND NOT regexp_matches(x.c, {BULLET})) AS h FROM parts),
chunks AS (SELECT p.doc_id || '-chunk-' || p."order" AS chunk_id, p.doc_id, {TITLE.replace('text', 'd.text')} AS title, source || '/' || p.doc_id AS source_path, p."order"::INT AS "order", p.text,
  coalesce(list_filter(h, lambda x: x.s LIKE '#%')[-1].c, list_filter(h, lambda x: x.s NOT LIKE '#%' AND len(x.c) <= 90 AND NOT regexp_matches(x.c, '[。？！.?!;；:]\z'))[-1].c, '') AS section_heading
  FROM hl AS p JOIN documents AS d USING (doc_id))"""


@query("chunk_documents", CHUNK_SQL + " SELECT * FROM chunks")
def chunk_documents(spark, d):
    return chunking.chunk_documents(titled(spark, d))


@query("index_summary", CHUNK_SQL + " SELECT count(DISTINCT source_path) AS documents, count(*) AS chunks FROM chunks")
def index_summary(spark, d):
    c = chunking.chunk_documents(titled(spark, d))
    return c.agg(F.countDistinct("source_path").alias("documents"), F.count("*").alias("chunks"))


def chunked(spark, d):
    return chunked_of(titled(spark, d))


def chunked_of(docs):
    c = chunking.chunk_documents(docs)
    return c.withColumn("chunk_sk", F.struct("doc_id", "order")).withColumn("heading", F.col("section_heading"))


CHUNK_BM25_SQL = bm25_sql().replace(f"docs AS (SELECT doc_id AS chunk_sk, {TITLE} AS title, text, source FROM documents)", "docs AS (SELECT {'doc_id': doc_id, 'order': \"order\"} AS chunk_sk, title, section_heading, text, source_path, concat_ws(' ', nullif(section_heading, ''), nullif(title, '')) AS heading FROM chunks)")
CHUNK_BM25_SQL = CHUNK_SQL + "," + CHUNK_BM25_SQL.replace(f"list_distinct({TOK.format('title')}) AS ht", f"list_distinct({TOK.format('heading')}) AS ht").removeprefix("WITH")


@query("bm25_over_chunks", CHUNK_BM25_SQL + ' SELECT query_id, chunk_sk.doc_id AS doc_id, chunk_sk."order" AS "order", score, heading_hits, rank FROM top')
def bm25_over_chunks(spark, d):
    found = search.search(search.build_index(chunked(spark, d).select("chunk_sk", "title", "heading", "text")), asked(spark, d))
    return found.select("query_id", "chunk_sk.doc_id", "chunk_sk.order", "score", "heading_hits", "rank")


@query("sources_over_chunks", CHUNK_BM25_SQL + f""" SELECT query_id, rank, title, source_path AS path, round(score, 3) AS score, {strip('substring(text, 1, 320)')} AS snippet, section_heading FROM top JOIN docs USING (chunk_sk)""")
def sources_over_chunks(spark, d):
    found = search.search(search.build_index(chunked(spark, d).select("chunk_sk", "title", "heading", "text")), asked(spark, d))
    # only documents with a chunk that was found are cut into chunks again
    docs = titled(spark, d).join(F.broadcast(found.select("chunk_sk.doc_id").distinct()), "doc_id", "left_semi")
    one = answer.sources(F.broadcast(found).join(chunked_of(docs), "chunk_sk"))
    return one.select("query_id", "rank", "source.title", "source.path", "source.score", "source.snippet", "source.section_heading")


@query("heading_cleanup_pages", r"SELECT page_id, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(" + strip("html") + r", '^#{1,6}[\s\x0b\x1c-\x1f\x{85}\p{Z}]*', ''), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '[ \t]{2,}', ' ', 'g'), '^[ \-–:：]+|[ \-–:：]+\z', '', 'g') AS cleaned FROM pages")
def heading_cleanup_pages(spark, d):
    return read(spark, d, "pages").select("page_id", F.expr(T.clean_heading("html")).alias("cleaned"))


@query("history_retention50", "SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 50")
def history_retention50(spark, d):
    return store.retained(read(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")


@query("history_pruned", "SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p > 50")
def history_pruned(spark, d):
    return store.pruned(read(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")


@query("history_latest20", "SELECT event_id, user_id, event_type, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS created_at, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS place FROM events) WHERE place <= 20")
def history_latest20(spark, d):
    rows = store.newest(read(spark, d, "events"), "user_id", "ts", "event_id", 20)
    return rows.select("event_id", "user_id", "event_type", F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "place")


@query("history_delete", "SELECT event_id, user_id FROM events WHERE NOT (user_id = 7 AND event_type = 'click')")
def history_delete(spark, d):
    return read(spark, d, "events").filter("NOT (user_id = 7 AND event_type = 'click')").select("event_id", "user_id")


def snapshots(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    old = o.filter("o_orderkey % 10 < 7")
    return old, o.filter("o_orderkey % 10 >= 3").withColumn("o_orderdate", F.expr("o_orderdate + INTERVAL 1 DAY"))


@query("materials_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END AS o_orderdate, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 >= 3")
def materials_upsert(spark, d):
    return store.upserted(*snapshots(spark, d), "o_orderkey", "o_orderdate")


@query("materials_prune", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 < 3")
def materials_prune(spark, d):
    return store.vanished(*snapshots(spark, d), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("insert_ignore", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END AS o_orderdate, o_orderstatus, o_totalprice FROM orders")
def insert_ignore(spark, d):
    return store.insert_ignore(*snapshots(spark, d), "o_orderkey")


@query("cascade_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def cascade_delete(spark, d):
    return store.cascaded(read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'"), "o_custkey", "c_custkey")


@query("materials_listing", "SELECT c_custkey, c_name, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, lower(c_name), c_custkey)::INT AS place FROM customer")
def materials_listing(spark, d):
    return store.listed(read(spark, d, "customer"), "c_nationkey", "c_acctbal", "c_name", "c_custkey").select("c_custkey", "c_name", "c_nationkey", "place")


@query("json_fields", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def json_fields(spark, d):
    return read(spark, d, "events").select("event_id", F.coalesce(F.from_json("props", "k long")["k"], F.lit(-1)).alias("k"))


@query("md5_hash", "SELECT doc_id, md5(text) AS md5 FROM documents")
def md5_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))


BLANK_SQL = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def trimmed_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{BLANK_SQL}+|{BLANK_SQL}+\z', '', 'g')"


@query("snippet_truncate", f"WITH n AS (SELECT doc_id, {trimmed_sql(f"regexp_replace(coalesce(text, ''), '{BLANK_SQL}+', ' ', 'g')")} AS t FROM documents) SELECT doc_id, CASE WHEN len(t) <= 88 THEN t ELSE substring(t, 1, 87) || '…' END AS snippet FROM n")
def snippet_truncate(spark, d):
    return read(spark, d, "documents").select("doc_id", F.expr(P.truncated("text")).alias("snippet"))


@query("source_snippet", rf"""WITH t AS (SELECT page_id, string_split(replace(regexp_replace(replace(html, '&nbsp;', ' '), '</?[A-Za-z][^>]*>', '', 'g'), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM pages),
f AS (SELECT page_id, ls, list_position(list_transform(ls, lambda x: {trimmed_sql('x')} NOT IN ('', ']', '\]')), true) AS k FROM t)
SELECT page_id, CASE WHEN coalesce(k, 0) = 0 THEN '' ELSE {trimmed_sql("array_to_string(list_slice(ls, k, len(ls)), chr(10))")} END AS snippet FROM f""")
def source_snippet(spark, d):
    return read(spark, d, "pages").select("page_id", F.expr(P.source_snippet("html")).alias("snippet"))


@query("source_link", """SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN '' ELSE '/api/source?path=' || replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') END AS link FROM pages""")
def source_link(spark, d):
    return read(spark, d, "pages").select("page_id", F.expr(P.source_link("url", "CAST(NULL AS int)")).alias("link"))


def file_size_sql(n: str) -> str:
    whole = lambda u: f"((2 * {n} + {u}) // {2 * u})::VARCHAR"
    tenths = lambda u: f"((20 * {n} + {u}) // {2 * u} // 10) || '.' || ((20 * {n} + {u}) // {2 * u} % 10)"
    unit = lambda u, name: f"CASE WHEN {n} >= {10 * u} THEN {whole(u)} ELSE {tenths(u)} END || ' {name}'"
    return f"CASE WHEN {n} IS NULL OR {n} <= 0 THEN '0 B' WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN {unit(1 << 10, 'KB')} WHEN {n} < 1073741824 THEN {unit(1 << 20, 'MB')} ELSE {unit(1 << 30, 'GB')} END"


@query("file_size_format", f"WITH s AS (SELECT source, sum(strlen(text))::BIGINT AS total FROM documents GROUP BY source) SELECT doc_id, {file_size_sql('strlen(text)')} AS size, {file_size_sql('total')} AS source_size, {file_size_sql('(total * 4096)')} AS scaled FROM documents AS d LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source")
def file_size_format(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("n"))
    totals = rows.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("total"))
    both = rows.join(totals, F.col("source").eqNullSafe(F.col("of")), "left")
    return both.select("doc_id", F.expr(P.file_size("n")).alias("size"), F.expr(P.file_size("total")).alias("source_size"), F.expr(P.file_size("(total * 4096)")).alias("scaled"))


@query("history_times", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS label FROM events")
def history_times(spark, d):
    return read(spark, d, "events").select("event_id", F.expr(P.time_label("ts")).alias("label"))


LITERALS = ["K-Means++ 的初始化 émile", "什么问题", "的 a", "- a --- |---|", "## 1. Foo", "### 1.1 Foo", "- foo bar", "* foo bar", "请问 聚类 是什么？ k-means", "user_01@x", "a", "bad name!", "报告<1>?.MD", "...", "C:/tmp/a b.md"]
VALUES = ", ".join(f"({i}, '{x}')" for i, x in enumerate(LITERALS))


def literals(spark) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {VALUES} AS t(i, s)")


STOP_LIST = "['" + "', '".join(T.STOP_BIGRAMS) + "']"


@query("cjk_tokens_literals", f"""SELECT i, array_to_string(list_filter(list_concat({TOK.format('s')}, flatten(list_transform(regexp_extract_all(lower(s), '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: CASE WHEN len(r) = 1 THEN [r] ELSE list_transform(range(1, len(r)), lambda p: substring(r, p, 2)) END))), lambda x: NOT list_contains({STOP_LIST}, x)), '|') AS tokens FROM (VALUES {VALUES}) AS t(i, s)""")
def cjk_tokens_literals(spark, d):
    return literals(spark).select("i", F.expr(f"array_join({T.tokens('s')}, '|')").alias("tokens"))


@query("username_validation", rf"SELECT i, regexp_full_match({strip('s')}, '[\p{{L}}\p{{N}}_.@+\-]{{2,32}}') AS valid FROM (VALUES {VALUES}) AS t(i, s)")
def username_validation(spark, d):
    return literals(spark).select("i", F.expr(T.strip("s") + r" RLIKE '^[\\p{L}\\p{N}_.@+\\-]{2,32}\\z'").alias("valid"))


@query("heading_literals", f"SELECT * FROM (VALUES (4, ''), (5, '1.1 Foo'), (6, 'foo bar'), (7, '')) AS t(i, heading)")
def heading_literals(spark, d):
    return literals(spark).filter("i BETWEEN 4 AND 7").select("i", F.expr(T.section_heading("s")).alias("heading"))


UPLOAD_SQL = rf"""WITH b AS (SELECT i, regexp_extract(regexp_replace({strip('s')}, '(?:/+\.?)+\z', ''), '[^/]*\z') AS b FROM (VALUES {VALUES}) AS t(i, s)),
n AS (SELECT i, CASE WHEN b = '.' THEN '' ELSE b END AS n FROM b),
e AS (SELECT i, n, regexp_extract(n, '(?s)^.+(\.[^.]+)\z', 1) AS e FROM n),
f AS (SELECT i, e, trim(regexp_replace({strip('substring(n, 1, len(n) - len(e))')}, '[^0-9A-Za-z\x{{4e00}}-\x{{9fff}}._()\-\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '_', 'g'), ' ._') AS f FROM e)
SELECT i, CASE WHEN f = '' THEN 'course_material' ELSE f END || lower(e) AS name FROM f"""


@query("upload_name_sanitize", UPLOAD_SQL)
def upload_name_sanitize(spark, d):
    return literals(spark).select("i", F.expr(P.upload_name("s")).alias("name"))


@query("upload_names_of_pages", UPLOAD_SQL.replace(f"(VALUES {VALUES}) AS t(i, s)", "(SELECT page_id AS i, url || '?é&x=%20y .' || substring(url, 9, 4) || 'HTML' AS s FROM pages)"))
def upload_names_of_pages(spark, d):
    return read(spark, d, "pages").select(F.col("page_id").alias("i"), F.expr(P.upload_name("concat(url, '?é&x=%20y .', substring(url, 9, 4), 'HTML')")).alias("name"))


@query("escape_html", """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def escape_html(spark, d):
    return read(spark, d, "pages").select("page_id", F.expr(T.escaped("html")).alias("escaped"))
