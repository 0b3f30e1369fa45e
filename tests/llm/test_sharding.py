import re
import zlib

from marginalia.llm.sharding import op10_sharding, shard, write_shards


def sound(rows, shards):
    slots = {}
    for r in rows:
        assert 0 <= r.shard < shards and r.grown_shard in (r.shard, shards)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    df = op10_sharding(spark, "/root/testdata/sf0.01")
    rows = df.collect()
    sound(rows, 8)
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    assert sorted(rows) == sorted(op10_sharding(spark, "/root/testdata/sf0.01").collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
    moved = sum(r.grown_shard == 8 for r in rows)
    assert 0.05 < moved / len(rows) < 0.18


def test_shuffled_and_same_for_any_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = shard(docs, 3, bucket_bytes=40_000).collect()
    b = shard(docs.repartition(7), 3, bucket_bytes=40_000).collect()
    sound(a, 3)
    assert sorted(a, key=str) == sorted(b, key=str)
    order = [r.doc_id for r in sorted((r for r in a if r.shard == 0), key=lambda r: r.slot)]
    assert order != sorted(order)
    c = shard(docs, 4, bucket_bytes=40_000).collect()
    now = {r.doc_id: r.shard for r in c}
    assert all(now[r.doc_id] == r.grown_shard for r in a)
    assert sorted(shard(docs, 3, bucket_bytes=40_000, broadcast_buckets=0).collect(), key=str) == sorted(a, key=str)


def test_edge_cases(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (None, None), (1, None), (2, ""), (3, "é" * 100_000), (4, "x"), (4, "x"), (4, "x")], "size long, shard string")
    rows = shard(df, 2, bucket_bytes=100, id_col="size", text_col="shard").collect()
    assert len(rows) == 9
    docs = df.withColumnsRenamed({"size": "doc_id", "shard": "text"})
    rows = shard(docs, 2, bucket_bytes=100)
    sound(rows.collect(), 2)
    assert sorted(r["size"] for r in rows.collect()) == [1, 1, 1, 2, 2, 2, 2, 2, 200_001]
    write_shards(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    assert shard(docs.limit(0)).count() == 0


def test_slots_against_a_plain_shuffle(spark):
    """Buckets, their order and Fisher-Yates recomputed: Spark's shuffle() puts each next row at a random place among those
    so far, with a Mersenne twister seeded by the seed plus the partition's number."""
    import numpy as np
    import xxhash

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    shards, seed, size = 3, 11, 40_000
    rows = {r.doc_id: r for r in shard(df, shards, seed, size).collect()}

    def hashed(*parts):
        """xxhash64 of values one after another, each with the hash before as its seed."""
        h = 42
        for p in parts:
            data = p.encode() if isinstance(p, str) else p.to_bytes(8 if abs(p) >= 1 << 31 or isinstance(p, Long) else 4, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
        return h - (1 << 64) if h >> 63 else h

    class Long(int):
        pass

    def shard_of(i, n):
        return min(range(n), key=lambda s: (-hashed(seed, s, Long(i)), s))

    total = sum(len(t.encode()) + 1 for _, t in docs)
    per = -(-total // (shards * size))
    buckets = {}
    for i, t in docs:
        turn = hashed(seed + 1, Long(hashed(Long(i))), t, Long(0))
        s = shard_of(i, shards)
        buckets.setdefault(s * per + turn % per, []).append((turn, i, t))
    start, want = {}, {}
    for b in sorted(buckets):
        s = b // per
        key = seed + b
        rng = np.random.RandomState(np.array([key >> 32, key & 0xFFFFFFFF], np.uint32))

        def below(n, rng=rng):
            while True:
                bits = int(rng.randint(0, 1 << 32, dtype=np.uint32)) >> 1
                if n & (n - 1) == 0:
                    return (n * bits) >> 31
                if bits - bits % n + n - 1 < 1 << 31:
                    return bits % n

        order = []
        for k in range(len(buckets[b])):
            j = below(k + 1)
            order.append(k)
            if j != k:
                order[k], order[j] = order[j], k
        for at, k in enumerate(order):
            want[sorted(buckets[b])[k][1]] = (s, start.get(s, 0) + at)
        start[s] = start.get(s, 0) + len(order)
    assert {i: (r.shard, r.slot) for i, r in rows.items()} == want
    assert all(r.grown_shard == shard_of(i, shards + 1) for i, r in rows.items())


def test_identical_rows_spread(spark):
    """20,000 rows alike, buckets of 10 kB: no bucket, and so no task, gets more than its share."""
    from pyspark.sql import functions as F

    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    docs = same.union(spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string"))
    for df in (docs, docs.withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))):
        out = shard(df, 4, bucket_bytes=10_000)
        rows = out.withColumn("p", F.spark_partition_id()).collect()
        sound(rows, 4)
        alike = [r.p for r in rows if r.text == "the same text"]
        most = max(alike.count(p) for p in set(alike))
        assert len(alike) == 20_000 and most < 4 * 20_000 / len(set(alike)) and len(set(alike)) > 5
    again = shard(docs.repartition(9), 4, bucket_bytes=10_000).collect()
    assert sorted(again, key=str) == sorted(shard(docs, 4, bucket_bytes=10_000).collect(), key=str)


def test_written_in_the_order_of_slots(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    write_shards(shard(docs, 3, bucket_bytes=40_000), str(tmp_path / "out"))
    import pyarrow.parquet as pq

    files = list((tmp_path / "out").rglob("*.parquet"))
    slots = [pq.ParquetFile(f).read(columns=["slot"])["slot"].to_pylist() for f in files]
    assert len(files) > 3 and all(s == list(range(s[0], s[0] + len(s))) for s in slots)
