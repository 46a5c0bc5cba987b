"""Rebuilding tables when files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorespark.sources import files

FILES = "path string, modificationTime timestamp, length long, content binary"


def refresh(spark: SparkSession, path: str, checkpoint: str, rebuild: Callable[[DataFrame], None], suffixes: tuple[str, ...] = (".md",), once: bool = True) -> StreamingQuery:
    """Calls rebuild with all files under path whenever new ones are there. Only names are streamed: a batch says
    that something came, and the whole folder is scanned, as statistics of an index depend on all of it."""
    names = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path).select("path")

    def batch(new: DataFrame, _: int) -> None:
        if not new.isEmpty():
            rebuild(files.scan(new.sparkSession, path, suffixes))

    writer = names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
