"""Commands on notes as rows of the event log: what each writes, and what takes it back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds of commands, and the event that each writes.
EVENTS = {"create": "NoteCreated", "rename": "NoteUpdated", "write": "NoteUpdated", "delete": "NoteDeleted", "select": "UiStateSet"}


def event_pairs(commands: DataFrame, key: str = "id", seq: str = "seq", kind: str = "kind", value: str = "value") -> DataFrame:
    """(key, seq, event, field, value, undo, undo_value) of commands (key, seq, kind, value): the event that a command
    writes, and the one that takes it back. Creating is undone by deleting, deleting by creating again; a changed title or
    content goes back to what the note's last command since its creation or deletion left there."""
    life = F.sum(F.col(kind).isin("delete", "create").cast("int")).over(Window.partitionBy(key).orderBy(seq))
    rows = commands.withColumn("__life", life)
    before = Window.partitionBy(key, "__life").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)

    def last(field: str) -> Column:
        return F.last(F.when(F.col(kind) == field, F.col(value)), ignorenulls=True).over(before)

    field = F.when(F.col(kind) == "rename", "title").when(F.col(kind) == "write", "content")
    undo = F.when(F.col(kind) == "create", "NoteDeleted").when(F.col(kind) == "delete", "NoteCreated").when(F.col(kind).isin("rename", "write"), "NoteUpdated")
    old = F.when(F.col(kind) == "rename", last("rename")).when(F.col(kind) == "write", last("write"))
    event = F.element_at(F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair]), F.col(kind))
    return rows.select(key, seq, event.alias("event"), field.alias("field"), F.when(field.isNotNull(), F.col(value)).alias("value"), undo.alias("undo"), old.alias("undo_value"))


def answered(requests: DataFrame, id_col: str, prompt_col: str, ask: Callable[[list[str]], list[str]], batch: int = 5) -> DataFrame:
    """(id_col, json): what a model's provider answers to prompts, `batch` at a time. ask gets a list of prompts; a batch on
    which it fails, or an answer that is none, is an empty list of entities."""
    given = requests.select(F.col(id_col).alias("id"), F.col(prompt_col).cast("string").alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            prompts, answers = rows.column(1).to_pylist(), []
            for at in range(0, len(prompts), batch):
                part = prompts[at : at + batch]
                try:
                    found = list(ask(part))
                except Exception:  # noqa: BLE001: whatever a provider raises, its requests have no entities
                    found = []
                answers += [x if isinstance(x, str) else "[]" for x in [*found, *[None] * len(part)][: len(part)]]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(answers, pa.string())], names=["id", "json"])

    return given.mapInArrow(run, f"id {dict(given.dtypes)['id']}, json string").withColumnRenamed("id", id_col)
