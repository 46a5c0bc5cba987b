"""Uploads, seeding and the paths of a user's files: small work on the driver, on any store that Hadoop reads."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import present as P


def free_name(name: str, taken: set[str]) -> str:
    """name, or the first of stem-1, stem-2, ... that isn't taken."""
    cut = name.rfind(".")
    stem, suffix = (name[:cut], name[cut:]) if 0 < cut < len(name) - 1 else (name, "")
    n, found = 0, name
    while found in taken:
        n += 1
        found = f"{stem}-{n}{suffix}"
    return found


def unique_names(new: DataFrame, there: DataFrame) -> DataFrame:
    """new (folder, nr, name) gets the names (folder, nr, name, stored_as) under which files can be stored one after
    another, beside what is there (folder, name). A folder is the unit of work, as each name depends on those before."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, taken = left.sort_values("nr"), set(right["name"])
        out = []
        for name in left["name"]:
            out.append(free_name(name, taken))
            taken.add(out[-1])
        return left.assign(stored_as=pd.Series(out, index=left.index, dtype="object"))[["folder", "nr", "name", "stored_as"]]

    safe = new.select(F.col("folder").cast("string").alias("folder"), F.col("nr").cast("long").alias("nr"), F.expr(P.upload_name("name")).alias("name"))
    old = there.select(F.col("folder").cast("string").alias("folder"), "name")
    return safe.groupBy("folder").cogroup(old.groupBy("folder")).applyInPandas(one, "folder string, nr long, name string, stored_as string")


def inside(root: str, path: str, suffixes: tuple[str, ...]) -> bool:
    """Whether a path, taken from root and without its dots, stays in root and has one of the suffixes."""
    root = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(root, path.strip()))
    return bool(path.strip()) and full.startswith(root.rstrip("/") + "/") and posixpath.splitext(full)[1].lower() in {s.lower() for s in suffixes}


def _store(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def save_uploads(spark: SparkSession, folder: str, files: list[tuple[str, bytes]], suffixes: tuple[str, ...] = (".md",), most: int = 20 << 20) -> list[str]:
    """Store files (name, bytes) under safe names that are free, and give those names. If one can't be stored, none is."""
    store, path = _store(spark, folder)
    store.mkdirs(path(folder))
    taken, saved = {s.getPath().getName() for s in store.listStatus(path(folder))}, []
    names = [r[0] for r in spark.createDataFrame([(i, n) for i, (n, _) in enumerate(files)], "i int, n string").orderBy("i").select(F.expr(P.upload_name("n"))).collect()]
    try:
        for name, (_, data) in zip(names, files):
            if posixpath.splitext(name)[1].lower() not in suffixes or len(data) > most:
                raise ValueError(f"{name} can't be taken")
            name = free_name(name, taken)
            out = store.create(path(f"{folder}/{name}"), False)
            saved.append(name)
            out.write(data)
            out.close()
            taken.add(name)
    except Exception:
        for name in saved:
            store.delete(path(f"{folder}/{name}"), False)
        raise
    return saved


def delete_file(spark: SparkSession, root: str, path: str, suffixes: tuple[str, ...] = (".md",)) -> None:
    """Delete one file of a folder; PermissionError outside of it, FileNotFoundError where there is none."""
    if not inside(root, path, suffixes):
        raise PermissionError(path)
    store, at = _store(spark, root)
    if not store.isFile(at(f"{root}/{path.strip()}")):
        raise FileNotFoundError(path)
    store.delete(at(f"{root}/{path.strip()}"), False)


def seed(spark: SparkSession, source: str, target: str, suffixes: tuple[str, ...] = (".md",)) -> int:
    """Copy a folder's files, tree and all, to one that has none of the suffixes yet; the number of files."""
    store, path = _store(spark, source)
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def names(folder: str) -> list[str]:
        if not store.exists(path(folder)):
            return []
        found, at, base = [], store.listFiles(path(folder), True), store.makeQualified(path(folder)).toUri().getPath().rstrip("/")
        while at.hasNext():
            name = at.next().getPath().toUri().getPath()[len(base) + 1 :]
            if posixpath.splitext(name)[1].lower() in suffixes and not posixpath.basename(name).startswith("~$"):
                found.append(name)
        return sorted(found)

    if names(target):
        return 0
    for name in (chosen := names(source)):
        store.mkdirs(path(f"{target}/{name}").getParent())
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, path(f"{source}/{name}"), store, path(f"{target}/{name}"), False, conf)
    return len(chosen)
