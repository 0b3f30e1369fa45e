"""Queries that run a stream to its end, with SQL over the same rows at rest, and the queue and stream-source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import log as G
from ..sources.tables import new_path
from ..streaming import events as E
from ..streaming import stateful as S


def _stream(spark, d):
    return E.source(spark, f"{d}/events*.parquet")


def stream_fold(spark, d):
    """The log arrives as a stream, is appended batch by batch, and the table is the fold of what has arrived."""
    log = E.run_to_end(_stream(spark, d), "log", "append")
    t = F.col("event_type")
    f = G.fold(log, "user_id", "event_id", t == "signup", t.isin("click", "view"), t == "error", F.col("value"))
    return f.select("user_id", "created_seq", "updated_seq", F.round("value", 6).alias("value"))


def stream_windows(spark, d):
    w = E.run_to_end(E.hourly(_stream(spark, d)), "hours", "complete")
    return w.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark, d):
    return E.run_to_end(E.user_sessions(_stream(spark, d)), "sessions", "append")


def _in_legs(spark, d, order, made, mode, n=3):
    """The events arrive in n parts by order; after each the stream is started anew and goes on from its checkpoint.
    made(stream) is what is run; the rows it wrote, with the number of their batch."""
    e = spark.read.parquet(f"{d}/events.parquet")
    e = e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    at = F.unix_micros("ts") if order == "ts" else F.col(order)
    cuts = sorted(set(e.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 10_000)).first()[0] or ()))
    into, out = new_path(spark, "arrivals"), new_path(spark, "legs")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = e.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.write.mode("append").parquet(into)
        stream = spark.readStream.schema(e.schema).parquet(into)
        with S.state_store(spark):
            rows = E.run_to_end(made(stream), "legs", mode, out=out)
    return spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, n long").option("basePath", f"{out}/rows").parquet(f"{out}/rows/n=*")


def history_stream(spark, d):
    """command_history as a stream that is stopped and started again twice: what each user's history is at last."""
    t = F.col("event_type")
    action = F.when(t == "click", "do").when(t == "view", "undo").when(t == "purchase", "redo")
    rows = _in_legs(spark, d, "event_id", lambda s: S.histories(s, "user_id", "event_id", action), "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("undo", "redo", "last"), "n").alias("h")).select("user_id", "h.*")


def fold_view(spark, d):
    """event_fold_state as a view kept up by a stream, which reads of its state what a batch's keys need."""
    t = F.col("event_type")
    rows = _in_legs(spark, d, "event_id", lambda s: S.folded(s, "user_id", "event_id", t == "signup", t.isin("click", "view"), t == "error", F.col("value")), "update")
    now = rows.groupBy("user_id").agg(F.max_by(F.struct("live", "created_seq", "updated_seq", "value"), "n").alias("r")).where("r.live")
    return now.select("user_id", "r.created_seq", "r.updated_seq", F.round("r.value", 6).alias("value"))


def _quiet(spark, d, settle_s):
    return _in_legs(spark, d, "ts", lambda s: S.quiet(s.withWatermark("ts", "1 hour"), "user_id", "ts", "event_id", settle_s), "append")


def debounce_stream(spark, d):
    """Rows after which a user is quiet for ten minutes, told by timers, as far as the watermark has come."""
    return _quiet(spark, d, 600).where("settled").select("event_id", "user_id")


def idle_stream(spark, d):
    """Gaps of two hours or more that have ended, as far as the watermark has come."""
    return _quiet(spark, d, 600).where("quiet_us >= 7200000000").select("event_id", "user_id", "quiet_us")


def sse_text(spark, d):
    """Server-sent lines made of conversations: data lines are read, [DONE] and broken ones skipped, texts joined in
    order."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    line = F.when(F.col("turn") % 5 == 4, "data: [DONE]").when(F.col("turn") % 5 == 3, "data: {oops").otherwise(F.concat(F.lit("data: "), F.to_json(F.struct(F.col("text").alias("t")))))
    got = c.select("conv_id", "turn", line.alias("line")).where("startswith(line, 'data: ') and line <> 'data: [DONE]'").select("conv_id", "turn", F.get_json_object(F.substr("line", F.lit(7)), "$.t").alias("t"))
    return got.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("turn", "t")))), lambda x: x["t"]), "").alias("text"))


def live_connections(spark, d):
    """Notes arrive as a stream; each is parsed as it comes, and what it is connected with is appended."""
    docs = E.files(spark, f"{d}/documents*.parquet")
    n = docs.select(F.col("doc_id").alias("id"), "text")
    found = n.select("id", *[F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1)))).alias(k) for k, p in (("tags", T.TAG), ("mentions", T.MENTION), ("links", T.WIKI), ("crosses", T.CROSS))])
    return E.run_to_end(found, "connections", "append")


QUERIES = {f.__name__: f for f in (stream_fold, stream_windows, stream_sessions, history_stream, fold_view, debounce_stream, idle_stream, sse_text, live_connections)}

from .store import ORACLE_SQL as _STORE  # noqa: E402

ORACLE_SQL = {
    "stream_fold": _STORE["event_fold_state"],
    "stream_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "fold_view": _STORE["event_fold_state"],
    "debounce_stream": "with q as (select event_id, user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as nxt, max(ts) over () - interval 1 hour as mark from events) select event_id, user_id from q where (nxt is null or nxt >= ts + interval 10 minutes) and ts + interval 10 minutes <= mark",
    "idle_stream": "with q as (select event_id, user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as nxt, max(ts) over () - interval 1 hour as mark from events) select event_id, user_id, epoch_us(nxt) - epoch_us(ts) as quiet_us from q where nxt >= ts + interval 2 hours and nxt <= mark",
    "sse_text": "select conv_id, coalesce(string_agg(text, '' order by turn) filter (turn % 5 not in (3, 4)), '') as text from conversations where turn % 5 <> 4 group by 1",
    "stream_sessions": "with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), b as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from a), g as (select user_id, min(ts) as begin, max(ts) + interval 30 minutes as ending, count(*) as n from b group by user_id, s) select user_id, begin, n from g where ending <= (select max(ts) - interval 1 hour from events)",
    "live_connections": "select doc_id as id, " + ", ".join(f"cast(len(list_distinct(regexp_extract_all(text, '{p}', 1))) as integer) as {k}" for k, p in (("tags", "#(\\w+)"), ("mentions", "@(\\w+)"), ("links", "\\[\\[([^\\]]+)\\]\\]"), ("crosses", "<<([^>]+)>>"))) + " from documents",
}
