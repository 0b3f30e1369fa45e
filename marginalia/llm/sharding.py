"""Sharding by a two-pass external shuffle.

Pass one scatters the records by seeded hashes into buckets that fit in memory; each bucket belongs to one shard.
Pass two sorts a bucket by its records' hashes, so that its order depends on nothing but the records, shuffles it by
Fisher-Yates (Spark's shuffle() with a seed) and writes it. A bucket is one partition, whose number is the bucket's:
a lost task comes out the same when it runs again.

Law `key`: a record's shard is the one whose seeded hash with the record's id is largest (rendezvous hashing), so the
id and the number of shards decide, and with one more shard only records whose new hash is the largest move, all of
them into it. The bucket within the shard is a hash of the whole record: copies of a text spread over all of them.

Native: SQL functions only. The one table that is broadcast has a row for each bucket, of which there are
total bytes / bucket_bytes; beyond `broadcast_buckets` of them it is joined by a shuffle.

Nulls and edge cases: a null text has 0 bytes and is of size 1; records with a null id share a shard but spread over
its buckets by their texts; repeated rows get a slot each, and rows alike in id and text that are together larger than
a bucket are numbered and spread over their shard's buckets by that; a record larger than a bucket makes that bucket larger;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, new_path

SHARDS, SEED, BUCKET_BYTES = 8, 20, 16 << 20
BROADCAST_BUCKETS = 100_000
COPIES = 1000  # of one row that one task makes


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing; a tie goes to the lower shard."""
    ranks = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(-s).alias("s")) for s in range(shards)])
    return -F.array_max(ranks)["s"]


def _hot_copies(rows: DataFrame, bucket_bytes: int, scratch: Scratch) -> DataFrame:
    """rows with a number __copy, which tells apart rows that are alike and together larger than a bucket: there are total
    bytes / bucket_bytes such groups at most. Of such a group one row and its count are kept, and copies are made anew in
    runs of COPIES, each placed by itself; so their numbers depend on nothing but the count."""
    same = F.xxhash64(F.coalesce(F.xxhash64("__id"), F.lit(0)), F.col("__text"))
    keyed = rows.withColumn("__same", same)
    hot = scratch.write(keyed.groupBy("__same").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes)).select("__same"), "hot-copies")
    one = F.lit(0).cast("long")
    if hot.isEmpty():
        return rows.withColumn("__copy", one)
    groups = keyed.join(hot, "__same", "left_semi").groupBy("__id", "__text", "size").agg(F.count(F.lit(1)).alias("n"))
    runs = groups.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition(F.xxhash64("__text", "low"))
    copies = runs.withColumn("__copy", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + COPIES, "n") - 1)))
    return keyed.join(hot, "__same", "left_anti").select(*rows.columns, one.alias("__copy")).unionByName(copies.select(*rows.columns, "__copy"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text", broadcast_buckets: int = BROADCAST_BUCKETS) -> DataFrame:
    """id_col, text_col, size (UTF-8 bytes + 1), shard, slot (gapless from 0 in each shard) and grown_shard (with one
    shard more), each shard's rows in the order of their slots within a bucket's partition."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(key.alias("__id"), text.alias("__text"), size.alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    rows = _hot_copies(rows, bucket_bytes, Scratch(docs.sparkSession))
    turn = F.xxhash64(F.lit(seed + 1), F.coalesce(F.xxhash64("__id"), F.lit(0)), "__text", "__copy")
    rows = rows.withColumn("shard", shard_of(F.col("__id"), shards, seed)).withColumn("__turn", turn).drop("__copy")
    rows = rows.withColumn("__bucket", (F.col("shard") * per_shard + F.pmod("__turn", F.lit(per_shard))).cast("int"))
    counts = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__start"))
    if shards * per_shard <= broadcast_buckets:
        starts = F.broadcast(starts)
    scattered = rows.repartitionById(shards * per_shard, F.col("__bucket"))
    bucket = scattered.groupBy("__bucket").agg(F.sort_array(F.collect_list(F.struct("__turn", "__id", "__text", "size", "shard"))).alias("__rows"))
    shuffled = bucket.select("__bucket", F.shuffle("__rows", seed).alias("__rows"))
    out = shuffled.select("__bucket", F.posexplode("__rows").alias("__at", "__row")).join(starts, "__bucket")
    grown = shard_of(F.col("__row.__id"), shards + 1, seed)
    return out.select(F.col("__row.__id").alias(id_col), F.col("__row.__text").alias(text_col), F.col("__row.size").alias("size"), F.col("__row.shard").alias("shard"), (F.col("__start") + F.col("__at")).alias("slot"), grown.alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet, a folder for each shard; a bucket's file has its rows in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 by the law `key`: written, and the contract's columns made from what was written."""
    path = new_path(spark, "shards")
    write_shards(shard(spark.read.parquet(f"{sf_dir}/documents.parquet")), path)
    rows = spark.read.schema("doc_id long, text string, size long, slot long, grown_shard int, shard int").parquet(path)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
