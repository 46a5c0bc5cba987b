"""What several operators share: table access, the shared folder, batch sizes and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that a Python worker gets at once. Texts may be long, so rows alone bound nothing.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python workers small whatever the length of the texts. A session's own bounds stay if
    they are lower; plans are lazy, so the bounds are not lifted again."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.fullmatch(r"(-?\d+)\s*(\w*)", spark.conf.get(key)).groups()
        have = int(number) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(unit[:1].lower(), 1)
        if have <= 0 or have > most:
            spark.conf.set(key, most)


def local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, as in
    tests on one machine, a temporary folder becomes this session's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_lorespark_dir", None) or f"file://{tempfile.mkdtemp(prefix='lorespark-')}"
        spark._lorespark_dir = found
    return found.rstrip("/")


def open_folder(uri: str):
    """The Arrow file system of a folder and the path in it, for Python workers. Names of stores that only Hadoop has
    are told as Arrow knows them."""
    from pyarrow import fs

    kind, colon, rest = uri.partition(":")
    if not colon:
        return fs.FileSystem.from_uri("file://" + uri)
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "gcs": "gs"}.get(kind, kind) + ":" + rest)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lorespark-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, and no lost executor takes it along."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._lorespark_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that stored() wrote and nothing reads any more."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df._lorespark_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def in_order(docs: DataFrame, name: str) -> DataFrame:
    """docs with a string column that sorts as docs are ordered: rows read from files by part number, file and place
    in the file (a scan deals files by size, so its partitions don't tell), others by partition and place in it."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return docs.withColumn(name, F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    file = F.col("_metadata.file_name")
    part = F.lpad(F.regexp_extract(file, r"^part-(\d+)", 1), 10, "0")
    return docs.withColumn(name, F.concat_ws("/", part, file, F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): a row (node, root) for every node but the roots, where root is
    the smallest node reachable.

    Rounds of a large star and a small star step (each node's neighbours are linked to the smallest of
    them), so the number of rounds grows with the logarithm of a component's size. All steps are joins and
    aggregates; a hub's edges are spread over tasks by AQE, and each round is a table in the shared folder.
    Edges may repeat or be loops. An empty input gives an empty result."""

    def star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a > b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), name)
    was = state(now)
    while was[0]:
        then = stored(star(now), name)
        dropped(now)
        now, last = then, was
        was = state(now)
        if was == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
