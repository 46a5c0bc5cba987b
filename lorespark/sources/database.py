"""Tables of a database server as DataFrames, and snapshots written back."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table over JDBC; with a numeric key and its bounds it is read in parts, each by its own connection."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def write_table(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Replace a table's rows by a snapshot, keeping the table and its keys."""
    rows.write.format("jdbc").options(url=url, dbtable=table, truncate="true", **options).mode("overwrite").save()
