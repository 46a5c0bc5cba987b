"""Tables of history and materials as snapshots: every change is a query that gives the next snapshot."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.config import SETTINGS
from lorespark.functions import text as T


def newest(rows: DataFrame, user: str, at: str, key: str, n: int) -> DataFrame:
    """The newest n rows of each user (ties: the larger key), with their place."""
    order = Window.partitionBy(user).orderBy(F.desc(at), F.desc(key))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def listed(rows: DataFrame, user: str, at: str, name: str, key: str) -> DataFrame:
    """All rows of each user, the latest first (ties: by name in any case, then key), with their place."""
    order = Window.partitionBy(user).orderBy(F.desc(at), F.lower(name), key)
    return rows.withColumn("place", F.row_number().over(order))


def retained(rows: DataFrame, user: str, at: str, key: str, n: int = SETTINGS.history_kept) -> DataFrame:
    return newest(rows, user, at, key, n).drop("place")


def pruned(rows: DataFrame, user: str, at: str, key: str, n: int = SETTINGS.history_kept) -> DataFrame:
    """What retention deletes."""
    order = Window.partitionBy(user).orderBy(F.desc(at), F.desc(key))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") > n).drop("place")


def upserted(old: DataFrame, new: DataFrame, key: str, created: str) -> DataFrame:
    """The new snapshot; created stays that of the old row. Rows missing from new are gone."""
    prior = old.select(F.col(key), F.col(created).alias("_prior"))
    joined = new.join(prior, key, "left")
    return joined.select(*[F.coalesce("_prior", created).alias(created) if c == created else F.col(c) for c in new.columns])


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old, and of each key it doesn't have one row of new: the first by `order`, or else by the hash of the row."""
    values = [F.col(c) for c in new.columns if not new.schema[c].dataType.simpleString().startswith("map")]
    first = Window.partitionBy(key).orderBy(*([F.col(order)] if order else []), F.xxhash64(*values))
    once = new.withColumn("_nr", F.row_number().over(first)).filter("_nr = 1")
    return old.unionByName(once.select(*old.columns).join(old.select(key), key, "left_anti"))


def of_user(users: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The rows (user_id, ...) of the user with that name, stripped and in any case; none for a name that is blank or
    unknown."""
    who = users.filter(F.lower("username") == name.strip().lower()).select(F.col("id").alias("_id")).limit(1)
    return rows.join(F.broadcast(who), F.col("user_id") == F.col("_id"), "left_semi")


#: What is said of a new user.
NO_NAME, BAD_NAME, SHORT, TAKEN, DONE = "用户名不能为空。", "用户名需为 2 到 32 个字符，只允许字母、数字、中文和 . _ @ + -。", "密码至少需要 6 个字符。", "用户名已存在。", "注册成功，已自动登录。"


def registered(users: DataFrame, new: DataFrame) -> DataFrame:
    """new (username, password, and nr, their order): adds ok and message. A name is taken if a user has it, or a valid
    row before it, in any case."""
    rows = new.withColumn("username", F.expr(T.strip("coalesce(username, '')"))).withColumn("_key", F.lower("username"))
    bad = ~F.expr(r"username RLIKE '(?U)^[\\w.@+\\-一-鿿]{2,32}\\z'")
    short = F.length(F.coalesce("password", F.lit(""))) < 6
    rows = rows.withColumn("_wrong", F.when(F.col("username") == "", NO_NAME).when(bad, BAD_NAME).when(short, SHORT))
    before = Window.partitionBy("_key", F.col("_wrong").isNull()).orderBy("nr")
    there = users.select(F.lower("username").alias("_key"), F.lit(True).alias("_there")).distinct()
    rows = rows.withColumn("_nth", F.row_number().over(before)).join(there, "_key", "left")
    message = F.coalesce("_wrong", F.when(F.col("_there") | (F.col("_nth") > 1), TAKEN), F.lit(DONE))
    return rows.withColumn("message", message).withColumn("ok", F.col("message") == DONE).drop("_key", "_wrong", "_nth", "_there")


def record_ids(rows: DataFrame, at: str) -> DataFrame:
    """rows with a record_id: the second of `at`, and eight random hexadecimal digits."""
    return rows.withColumn("record_id", F.concat(F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), F.expr("substring(replace(uuid(), '-', ''), 1, 8)")))


def cascaded(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is still there."""
    return rows.join(parents.select(F.col(parent_key).alias("_parent")).distinct(), F.col(key) == F.col("_parent"), "left_semi")


def vanished(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti")
