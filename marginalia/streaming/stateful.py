"""Operators on streams that keep state for each key, in the state store of the checkpoint: they go on after a restart.

Histories keeps a bounded history of commands (two lists and the number of the last row). Fold keeps a table of the live
rows of a log, of which a batch touches only its own keys. Quiet finds the rows after which
a key is quiet for a time: rows wait until the watermark has passed them, so their order within its delay is not that of
arrival; a timer tells when nothing more can come in between, and rows that come twice count once.

State of a key is bounded: a history's length, or the rows of the watermark's delay. Rows of one key in one batch are
sorted in memory; a trigger's size bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sync import HISTORY, History

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, which these operators need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Histories(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done, self.undone = handle.getListState("done", "seq long"), handle.getListState("undone", "seq long")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now, last = History(self.most), self.last.get()[0] if self.last.exists() else None
        now.done, now.undone = ([x[0] for x in s.get()] if s.exists() else [] for s in (self.done, self.undone))
        for seq, action in sorted((r.seq, r.action) for r in rows):
            if last is None or seq > last:
                now.apply(action, seq)
                last = seq
        for state, seqs in ((self.done, now.done), (self.undone, now.undone)):
            state.put([(x,) for x in seqs]) if seqs else state.clear()
        self.last.update((last,))
        yield Row(key=key[0], undo=len(now.done), redo=len(now.undone), last=now.done[-1] if now.done else None)

    def close(self) -> None:
        pass


def histories(stream: DataFrame, key: str, seq: str, action: Column, most: int = HISTORY) -> DataFrame:
    """(key, undo, redo, last): sync.histories() as a stream, in mode update: of each key whose rows a batch has, what its
    history is then. Rows of a key must come in order of seq from batch to batch; those that are behind are left out."""
    given = stream.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), action.alias("action")).where("action is not null and key is not null and seq is not null")
    kind = dict(given.dtypes)["key"]
    out = given.groupBy("key").transformWithState(Histories(most), f"key {kind}, undo int, redo int, last long", "Update", "None")
    return out.withColumnRenamed("key", key)


class Fold(StatefulProcessor):
    """State: the key's row, if it lives, and the number of the last event that was taken."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "created long, updated long, value double")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        row = list(self.row.get()) if self.row.exists() else None
        last, before = (self.last.get()[0] if self.last.exists() else None), self.row.exists()
        for seq, kind, value in sorted(((r.seq, r.kind, r.value) for r in rows), key=lambda r: r[0]):
            if last is not None and seq <= last:
                continue
            last = seq
            if kind == "delete":
                row = None
            elif kind == "create" and row is None:
                row = [seq, seq, value]
            elif kind == "update" and row is not None:
                row = [row[0], seq, row[2] if value is None else value]
        self.last.update((last,))
        if row is not None:
            self.row.update(tuple(row))
        else:
            self.row.clear()
        if row is not None or before:
            yield Row(key=key[0], live=row is not None, created_seq=row and row[0], updated_seq=row and row[1], value=row and row[2])

    def close(self) -> None:
        pass


def folded(stream: DataFrame, key: str, seq: str, create: Column, update: Column, delete: Column, value: Column) -> DataFrame:
    """(key, live, created_seq, updated_seq, value): log.fold() as a view that is kept up, in mode update. A batch reads the
    state of its own keys and tells what they are then (live is false for a key whose row went), however long the log is.
    Rows of a key must come in order of seq from batch to batch; those that are behind are left out."""
    kind = F.when(delete, "delete").when(create, "create").when(update, "update")
    given = stream.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), kind.alias("kind"), value.cast("double").alias("value")).where("kind is not null and key is not null and seq is not null")
    out = given.groupBy("key").transformWithState(Fold(), f"key {dict(given.dtypes)['key']}, live boolean, created_seq long, updated_seq long, value double", "Update", "None")
    return out.withColumnRenamed("key", key)


class Quiet(StatefulProcessor):
    """pending: rows (micros, seq) that the watermark has not passed; last: the newest row before it, and whether it was
    told as settled."""

    def __init__(self, settle_us: int):
        self.settle = settle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending, self.last = handle.getListState("pending", "us long, seq long"), handle.getValueState("last", "us long, seq long, told boolean")

    def _passed(self, key, more: list[tuple[int, int]], passed_us: int) -> Iterator[Row]:
        held = sorted({*((r[0], r[1]) for r in (self.pending.get() if self.pending.exists() else ())), *more})
        last = tuple(self.last.get()) if self.last.exists() else None
        rest = [r for r in held if r[0] > passed_us]
        for us, seq in held[: len(held) - len(rest)]:
            if last is not None and (us, seq) <= last[:2]:
                continue  # came twice
            if last is not None:
                told = last[2] or us - last[0] >= self.settle
                yield Row(key=key[0], seq=last[1], settled=told and not last[2], quiet_us=us - last[0])
            last = (us, seq, False)
        if last is not None and not last[2] and last[0] + self.settle <= passed_us:
            yield Row(key=key[0], seq=last[1], settled=True, quiet_us=None)
            last = (*last[:2], True)
        self.pending.put(rest) if rest else self.pending.clear()
        if last is not None:
            self.last.update(last)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        due = [rest[0][0]] if rest else []
        due += [last[0] + self.settle] if last is not None and not last[2] else []
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._passed(key, [(r.us, r.seq) for r in rows], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._passed(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def quiet(stream: DataFrame, key: str, ts: str, seq: str, settle_s: float) -> DataFrame:
    """(key, seq, settled, quiet_us) from a stream with a watermark on ts, in mode append. A row is told once as settled when
    nothing of its key follows for settle_s seconds, as soon as that is sure; and once with quiet_us, the time to the next
    row, when that row is passed by the watermark (in one row, if both come together)."""
    given = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(seq).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(ts).alias("us"), F.col(seq).cast("long").alias("seq"), F.col(ts).alias("__ts"))
    kind = dict(given.dtypes)["key"]
    out = given.groupBy("key").transformWithState(Quiet(round(settle_s * 1_000_000)), f"key {kind}, seq long, settled boolean, quiet_us long", "Append", "EventTime")
    return out.withColumnsRenamed({"key": key, "seq": seq})
