"""From raw documents to token shards: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. The model of the first stage is fitted on the labelled rows of its input; it
drops what it rejects. No SQL can express that model, so there is no ORACLE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import decontaminate, langid, mixing, simhash, wavelet
from lorespark.llm.common import stored, table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filtered(docs, langid.train(docs, F.lit(True)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards in the order of docs, the curriculum, and a row for each document read back from them; `start` is its
    place in training. `_lorespark_shards` of the result is the shards' manifest and folder."""
    return wavelet.training_output(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate_benchmark),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = stored(out, name)
    docs._lorespark_shards = out._lorespark_shards
    return docs
