"""Event logs folded into state, and ordered operators on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(log: DataFrame, key: str, seq: str, create: Column, update: Column, delete: Column, value: Column) -> DataFrame:
    """(key, created_seq, updated_seq, value) of each live key: the first create after the last delete starts a row,
    later creates are ignored, an update replaces the value (an update without a create, or before it, does nothing).
    Sums by key only, each before its shuffle, so a key of any number of events is no task's burden."""
    deleted = log.where(delete).groupBy(key).agg(F.max(seq).alias("__gone"))
    alive = log.join(deleted, key, "left").where(F.col("__gone").isNull() | (F.col(seq) > F.col("__gone")))
    born = alive.where(create).groupBy(key).agg(F.min(seq).alias("created_seq"))
    rest = alive.where(create | update).join(born, key).where((F.col(seq) == F.col("created_seq")) | (update & (F.col(seq) > F.col("created_seq"))))
    return rest.groupBy(key).agg(F.first("created_seq").alias("created_seq"), F.max(seq).alias("updated_seq"), F.max_by(value, F.when(value.isNotNull(), F.col(seq))).alias("value"))


def condensed(log: DataFrame, key: str, seq: str, kind: str, value: str, create: str, updates: list[str], delete: str) -> DataFrame:
    """The fewest rows (key, seq, kind, value) that fold() to the same state as the log, alone or with a tail of later rows:
    of each live key its creation with the value it has now, and its last update without one."""
    k = F.col(kind)
    f = fold(log, key, seq, k == create, k.isin(updates), k == delete, F.col(value))
    born = F.struct(F.col("created_seq").alias(seq), F.lit(create).alias(kind), F.col("value").alias(value))
    changed = F.struct(F.col("updated_seq").alias(seq), F.lit(updates[0]).alias(kind), F.lit(None).cast(dict(log.dtypes)[value]).alias(value))
    both = F.when(F.col("updated_seq") > F.col("created_seq"), F.array(born, changed)).otherwise(F.array(born))
    return f.select(key, F.inline(both)).select(key, seq, kind, value)


def latest(log: DataFrame, keys: list[str], seq: str, *columns: str) -> DataFrame:
    """The columns of the last row of each key; one aggregation."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(seq, *columns), seq).alias("__r")).select(*keys, "__r.*")


def sessions(log: DataFrame, key: str, ts: str, gap: str, *order: str) -> DataFrame:
    """Adds `session`, from 0 for each key: a new one starts where the gap to the key's row before is `gap` or more."""
    by = Window.partitionBy(key).orderBy(ts, *order)
    new = F.coalesce((F.col(ts) - F.lag(ts).over(by) >= F.expr(f"interval {gap}")).cast("int"), F.lit(0))
    return log.withColumn("__new", new).withColumn("session", F.sum("__new").over(by)).drop("__new")


def with_quiet(log: DataFrame, key: str, ts: str, *order: str) -> DataFrame:
    """Adds `quiet_s`, seconds until the key's next row (null: none)."""
    by = Window.partitionBy(key).orderBy(ts, *order)
    return log.withColumn("quiet_s", F.unix_micros(F.lead(ts).over(by).cast("timestamp")) / 1e6 - F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)


def newest(log: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in an order, numbered in `rank`."""
    return log.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def compaction(log: DataFrame, key: str, ts: str, size: Column, most: int, idle_s: float, *order: str) -> DataFrame:
    """Rows after which a key's log is compacted: the running size passes a multiple of `most` (looked at first), or
    nothing follows for idle_s seconds."""
    by = Window.partitionBy(key).orderBy(ts, *order)
    rows = with_quiet(log.withColumn("log_size", F.sum(size).over(by)).withColumn("__s", size), key, ts, *order)
    full = F.floor(F.col("log_size") / most) > F.floor((F.col("log_size") - F.col("__s")) / most)
    return rows.withColumn("reason", F.when(full, "size").when(F.col("quiet_s") >= idle_s, "idle")).where("reason is not null").drop("__s")
