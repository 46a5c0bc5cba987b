"""Import of users and history kept in JSON files. A file that is missing, empty or broken gives no rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import store

USER = "struct<password_hash string, created_at string>"
RECORD = "struct<id string, question string, answer string, mode string, sources array<struct<title: string, path: string, score: double, snippet: string, metadata: struct<md5: string, page_number: int, page_heading: string, row_number: int, source_type: string, section_heading: string>, page_number: int, section_heading: string, page_heading: string>>, created_at string>"


def entries(spark: SparkSession, folder: str, name: str, key: str, value: str) -> DataFrame:
    """The entries (username, value) of one object in one file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder)
    parsed = F.from_json(F.decode("content", "UTF-8"), f"{key} map<string, {value}>")
    rows = files.select(F.explode(parsed[key]).alias("username", "value"))
    return rows.withColumn("username", F.trim("username")).filter("username <> ''")


def moment(at: Column) -> Column:
    """A second; times without a zone are in UTC, whatever the session's, and what can't be read is now."""
    zoned = F.when(at.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), at).otherwise(F.concat(at, F.lit("Z")))
    return F.date_trunc("second", F.coalesce(F.try_to_timestamp(zoned), F.current_timestamp()))


def users(spark: SparkSession, folder: str, name: str = "users.json") -> DataFrame:
    rows = entries(spark, folder, name, "users", USER)
    return rows.select("username", F.coalesce("value.password_hash", F.lit("")).alias("password_hash"), moment(F.col("value.created_at")).alias("created_at"))


def history(spark: SparkSession, folder: str, owner: str, name: str = "history.json", moved: dict[str, str] | None = None) -> DataFrame:
    """Records of the owner; those of other users stay behind. moved: sources of files that were copied to the owner's
    folder, from old path to new; other paths stay."""
    rows = entries(spark, folder, name, "history", f"array<{RECORD}>").filter(F.col("username") == owner).select("username", F.explode("value").alias("r"))
    text = lambda c: F.coalesce(f"r.{c}", F.lit("")).alias(c)
    sources = F.col("r.sources")
    if moved:
        to = F.create_map(*[F.lit(x) for kv in moved.items() for x in kv])
        sources = F.transform(sources, lambda x: x.withField("path", F.coalesce(F.try_element_at(to, F.trim(x["path"])), x["path"])))
    sources = F.coalesce(F.to_json(sources, {"ignoreNullFields": "true"}), F.lit("[]")).alias("sources_json")
    return rows.select(F.col("r.id").alias("record_id"), "username", text("question"), text("answer"), text("mode"), sources, moment(F.col("r.created_at")).alias("created_at"))


def imported(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The next snapshot: rows that are there stay as they are; of new rows with the same key, the first one is taken."""
    return store.insert_ignore(old, new, key, order)
