import random

from pyspark.sql import functions as F

from marginalia import plans
from marginalia.operators import sync
from marginalia.sources.tables import new_path
from marginalia.streaming import events as E
from marginalia.streaming import stateful as S

DIR = "/root/testdata/sf0.001"
QUERIES, _ = plans.collected()


def run(spark, parts, schema, made, mode):
    """Parts arrive one after another; the stream is started anew for each. Rows written, with their batch."""
    into, out = new_path(spark, "in"), new_path(spark, "out")
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(into)
        with S.state_store(spark):
            E.run_to_end(made(spark.readStream.schema(schema).parquet(into)), "t", mode, out=out)
    return spark.read.parquet(f"{out}/rows").collect()


def test_histories_go_on_after_a_restart(spark):
    pick = random.Random(5)
    rows = [(f"k{pick.randrange(4)}", i, pick.choice(["do", "do", "undo", "redo", None])) for i in range(300)] + [(None, 400, "do")]
    schema = "k string, s long, a string"
    parts = [rows[:90], rows[90:200] + rows[80:90], rows[200:]]  # some come twice
    got = {}
    for r in sorted(run(spark, parts, schema, lambda s: S.histories(s, "k", "s", F.col("a"), 6), "update"), key=lambda r: r.n):
        got[r.k] = (r.undo, r.redo, r.last)
    want = sync.histories(spark.createDataFrame(rows, schema).where("k is not null"), "k", "s", F.col("a"), 6).collect()
    assert got == {r.k: (r.undo, r.redo, r.last) for r in want}


def test_a_kept_view_is_the_fold_of_the_log(spark):
    from marginalia.operators import log as G

    pick = random.Random(8)
    rows = [(pick.randrange(12), i, pick.choice(["create", "update", "update", "delete", "other"]), pick.choice([None, float(i)])) for i in range(400)]
    schema = "k long, s long, t string, v double"
    t = F.col("t")
    told = run(spark, [rows[:150], rows[150:260] + rows[140:150], [r for r in rows[260:] if r[0] < 3]], schema, lambda s: S.folded(s, "k", "s", t == "create", t == "update", t == "delete", F.col("v")), "update")
    now = {}
    for r in sorted(told, key=lambda r: r.n):
        now[r.k] = r
    log = spark.createDataFrame(rows[:260] + [r for r in rows[260:] if r[0] < 3], schema)
    want = G.fold(log, "k", "s", t == "create", t == "update", t == "delete", F.col("v")).collect()
    assert sorted((r.k, r.created_seq, r.updated_seq, r.value) for r in now.values() if r.live) == sorted(map(tuple, want)) and len(want) > 3
    assert {r.k for r in told if r.n == max(x.n for x in told)} <= {0, 1, 2}  # the last batch touches its own keys alone


def test_query_equals_the_batch_one(spark):
    want = QUERIES["command_history"](spark, DIR).select("user_id", "undo", "redo", "last").collect()
    assert sorted(map(tuple, QUERIES["history_stream"](spark, DIR).collect())) == sorted(map(tuple, want))


def test_quiet_with_disorder_repeats_and_late_rows(spark):
    def at(minute):
        return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"

    parts = [
        [("a", at(0), 1), ("a", at(5), 2), ("b", at(1), 3), ("a", at(40), 4)],
        [("a", at(30), 5), ("a", at(5), 2), ("b", at(12), 6), ("a", at(41), 7)],  # disorder within the delay, one row again
        [("b", at(200), 8), ("a", at(2), 9), (None, at(200), 10)],  # row 9 is late by more than the delay
        [("c", at(400), 11)],
    ]
    rows = run(spark, parts, "k string, ts string, s long", lambda s: S.quiet(s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "30 minutes"), "k", "ts", "s", 600), "append")
    settled = sorted(r.s for r in rows if r.settled)
    gaps = sorted((r.s, r.quiet_us // 60_000_000) for r in rows if r.quiet_us is not None)
    assert settled == [2, 3, 5, 6, 7, 8]  # 4 is followed by 7 after a minute; c's is still open
    assert gaps == [(1, 5), (2, 25), (3, 11), (4, 1), (5, 10), (6, 188)]


def test_the_store_setting_is_put_back(spark):
    before = spark.conf.get(S.PROVIDER, None)
    with S.state_store(spark):
        assert spark.conf.get(S.PROVIDER) == S.ROCKS
    assert spark.conf.get(S.PROVIDER, None) == before
