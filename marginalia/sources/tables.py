"""Tables of a data folder, the shapes that operators expect of them, and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, one is made for the application: for a local master
    in the machine's temporary folder, else in the user's folder of the default file system, which must not be local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='marginalia-')}" if master == "local" or master.startswith("local[") else _on_default(spark)
    return _own[app]


def _on_default(spark: SparkSession) -> str:
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{fs.getHomeDirectory().toString()}/.marginalia-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor."""
    return Scratch(df.sparkSession).write(df, name)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that an operator writes to the shared folder to cut its lineage, and deletes once they are read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables; others than write() gave are left alone."""
        for t in tables:
            for entry in [e for e in self.kept if e[0] is t]:
                removed(self.spark, entry[1])
                self.kept.remove(entry)

    def close(self) -> None:
        self.drop(*[t for t, _ in self.kept])

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that stays, once all others are deleted."""
        out = written(df, name)
        self.close()
        return out


def notes(docs: DataFrame) -> DataFrame:
    """Documents as notes: id, title, content, parent_id, ordinal, created_at (ISO text)."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), F.col("source").alias("parent_id"), F.col("doc_id").alias("ordinal"), stamp.alias("created_at"))


def folders(docs: DataFrame) -> DataFrame:
    """The distinct sources as root folders."""
    first = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.min("doc_id")), "yyyy-MM-dd'T'HH:mm:ss")
    return docs.groupBy("source").agg(first.alias("created_at")).select(F.col("source").alias("id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("parent_id"), "created_at")


def forest(region: DataFrame, nation: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """region over nation over customer and supplier, as (id, parent_id)."""
    def ids(prefix: str, c: str):
        return F.concat(F.lit(prefix), F.col(c).cast("string"))

    return (
        region.select(ids("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
        .union(nation.select(ids("n", "n_nationkey"), ids("r", "n_regionkey")))
        .union(customer.select(ids("c", "c_custkey"), ids("n", "c_nationkey")))
        .union(supplier.select(ids("s", "s_suppkey"), ids("n", "s_nationkey")))
    )
