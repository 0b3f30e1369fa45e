"""Vectors as short codes: one codebook entry for each part of a vector (product quantization), on integers.

A component x becomes floor(scale * x); a vector is cut into `parts` equal parts, each position with a codebook of its
own. A codebook starts as that part of the `entries` first vectors by id; each of `rounds` rounds assigns every part to
the nearest entry (squared Euclidean distance, ties to the lower index) and sets each entry to floor(sum / count) of its
parts; entries without parts stay. All of it is integer arithmetic, so results depend on no order of summation.

Nearest entries are found by equal-average search. For d components the squared distance is at least the squared gap of
the component sums over d. Entries are sorted by their sums; from a part's own sum the search goes outward to both sides
and stops on a side once that bound strictly exceeds the best distance so far (equal ones could still be a tie). Parts of
a batch are sorted by their sums too and go in blocks, so that a step compares a block's unfinished parts with the next
few entries as one matrix product.

Scale: vectors are never shuffled. A round is one scan of them; every task sums its parts by entry, and the sums of all
tasks, a row for each (part, entry), are added up by Spark. Codebooks (parts * entries rows) are all that reaches the
driver or is broadcast. Integers are exact up to 4 * d * x * x < 2**53 as matrix products of doubles, and as longs beyond;
those that a long could not hold the squared distances of are taken as the nearest that can (2**27 for 64 components).

Nulls and edge cases: dropped are vectors that are null, empty, hold a null or a component that is not finite, or are of
another length than the first by id. A length that can't be cut into equal parts is a ValueError. Null ids are kept and
come last in the order of ids; vectors of one id are ordered by their components. With fewer vectors than entries the
codebook has as many as there are; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK, STEP = 512, 32


def _limit(dim: int) -> int:
    """The largest integer component: dim * (2 * limit) ** 2 fits a long."""
    return 1 << (62 - max(dim - 1, 0).bit_length()) // 2 - 1


def integers(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) as longs."""
    most = float(_limit(x.shape[1]))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * scale), -most, most).astype(np.int64)


class Codebook:
    """The entries of one part position, sorted by their sums."""

    def __init__(self, entries: np.ndarray):
        self.order = np.argsort(entries.sum(axis=1), kind="stable")
        self.entries = entries[self.order]
        self.sums = self.entries.sum(axis=1)
        self.dim = entries.shape[1]
        self.largest = int(np.abs(entries).max(initial=0))
        self.real, self.norms = self.entries.astype(np.float64), (self.entries * self.entries).sum(axis=1)

    def _compare(self, x: np.ndarray, a: int, b: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of the sorted entries a to b each row's smallest distance, and the lowest index that has it."""
        if small:
            d = (self.norms[a:b] - 2 * (x.astype(np.float64) @ self.real[a:b].T)) + (x * x).sum(axis=1)[:, None]
            d = d.astype(np.int64)
        else:
            d = np.stack([((x - e) ** 2).sum(axis=1) for e in self.entries[a:b]], axis=1)
        least = d.min(axis=1)
        return least, np.where(d == least[:, None], self.order[a:b], len(self.order)).min(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance to it, for each row of x."""
        sums = x.sum(axis=1)
        most = max(self.largest, int(np.abs(x).max(initial=0)))
        small = 4 * self.dim * most * most < 1 << 53
        code, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        order = np.argsort(sums, kind="stable")

        def take(rows: np.ndarray, a: int, b: int) -> None:
            d, i = self._compare(x[rows], a, b, small)
            better = (d < best[rows]) | (d == best[rows]) & (i < code[rows])
            best[rows[better]], code[rows[better]] = d[better], i[better]

        def within(rows: np.ndarray, entry: int) -> np.ndarray:
            gap = (sums[rows] - self.sums[entry]).astype(np.float64)
            return rows[gap * gap * (1 - 1e-12) <= self.dim * best[rows].astype(np.float64)]  # a hair too many, never too few

        for at in range(0, len(x), BLOCK):
            rows = order[at : at + BLOCK]
            middle = int(np.searchsorted(self.sums, sums[rows[len(rows) // 2]]))
            low, high = max(0, middle - STEP // 2), min(len(self.sums), middle + STEP // 2)
            take(rows, low, high)
            below = above = rows
            while low > 0 or high < len(self.sums):
                if low > 0:
                    below = self._beyond(below, within, sums, low - 1, -1)
                    if len(below):
                        take(below, max(0, low - STEP), low)
                    low = max(0, low - STEP) if len(below) else 0
                if high < len(self.sums):
                    above = self._beyond(above, within, sums, high, 1)
                    if len(above):
                        take(above, high, min(len(self.sums), high + STEP))
                    high = min(len(self.sums), high + STEP) if len(above) else len(self.sums)
        return code, best

    def _beyond(self, rows: np.ndarray, within, sums: np.ndarray, entry: int, side: int) -> np.ndarray:
        """The rows that must go on at this entry: those whose own sum still lies further out, and those within the bound."""
        ahead = (sums[rows] - self.sums[entry]) * side > 0
        return np.union1d(rows[ahead], within(rows, entry))


def _matrix(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(-1, dim), scale)


def _slices(batch: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about a million components."""
    step = max(1, (1 << 20) // dim)
    return (batch.slice(a, step) for a in range(0, batch.num_rows, step))


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(x, parts, axis=1)]


class VectorCodes:
    """Codebooks fitted to all vectors of a table; rows() codes them, with the columns named in keep."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, keep: tuple[str, ...] = ()):
        if not (parts > 0 and 0 < entries <= 256 and rounds >= 0):
            raise ValueError("parts and entries must be positive, entries at most 256, rounds not negative")
        if clash := {"code", "error"} & set(keep):
            raise ValueError(f"rename {clash} first")
        self.parts, self.scale, self.spark, self.id, self.keep = parts, scale, vectors.sparkSession, id_col, tuple(keep)
        names = {"__id": id_col, "__vector": vector_col} | {f"__{i}": c for i, c in enumerate(keep)}
        own = vectors.select(*[F.col(f"`{c}`").alias(name) for name, c in names.items()])
        finite = F.forall("__vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
        self.kept = own.where(F.col("__vector").isNotNull() & (F.size("__vector") > 0) & finite)
        first = self._first(entries)
        self.dim = len(first[0]) if first else 0
        if self.dim % parts:
            raise ValueError(f"vectors of {self.dim} components can't be cut into {parts} equal parts")
        self.kept = self.kept.where(F.size("__vector") == self.dim)
        if any(len(v) != self.dim for v in first):
            first = self._first(entries)
        self.codebooks = _cut(integers(np.array(first, np.float64), scale), parts) if first else []
        for _ in range(rounds if first else 0):
            self._round()

    def _first(self, n: int) -> list[list[float]]:
        found = self.kept.orderBy(F.col("__id").asc_nulls_last(), "__vector").limit(n).select("__vector").collect()
        return [r[0] for r in found]

    def _round(self) -> None:
        books, dim, parts, scale = self.spark.sparkContext.broadcast(self.codebooks), self.dim, self.parts, self.scale
        wide, n = dim // parts, len(self.codebooks[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [Codebook(b) for b in books.value]
            sums, counts = np.zeros((parts, n, wide), np.int64), np.zeros((parts, n), np.int64)
            for part in (part for batch in batches for part in _slices(batch, dim)):
                for p, x in enumerate(_cut(_matrix(part.column(0), dim, scale), parts)):
                    code = found[p].nearest(x)[0]
                    order = np.argsort(code, kind="stable")
                    used, at = np.unique(code[order], return_index=True)
                    sums[p, used] += np.add.reduceat(x[order], at, axis=0)
                    counts[p] += np.bincount(code, minlength=n)
            p, e = np.nonzero(counts)
            total = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * wide), pa.array(sums[p, e].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()), total], names=["part", "entry", "n", "total"])

        rows = self.kept.select("__vector").mapInArrow(run, "part int, entry int, n long, total array<long>")
        exact = "decimal(38,0)"
        added = rows.groupBy("part", "entry").agg(F.sum(F.col("n").cast(exact)).alias("n"), *[F.sum(F.col("total")[i].cast(exact)).alias(f"s{i}") for i in range(wide)])
        after = [b.copy() for b in self.codebooks]
        for r in added.collect():  # parts * entries rows
            after[r[0]][r[1]] = [int(s) // int(r[2]) for s in r[3:]]
        self.codebooks = after
        books.unpersist()

    def digest(self) -> str:
        """SHA-256 of all entries' components, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for b in self.codebooks for v in b.ravel().tolist()).encode()).hexdigest()

    def rows(self) -> DataFrame:
        """Of each kept vector its id, the columns kept, code (a byte for each part) and error (the squared distances)."""
        books, dim, parts, scale = self.spark.sparkContext.broadcast(self.codebooks), self.dim, self.parts, self.scale
        names = ["__id", *[f"__{i}" for i in range(len(self.keep))]]
        kinds = dict(self.kept.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [Codebook(b) for b in books.value]
            for part in (part for batch in batches for part in _slices(batch, dim)):
                told = [c.nearest(x) for c, x in zip(found, _cut(_matrix(part.column(len(names)), dim, scale), parts), strict=True)]
                codes = np.stack([c for c, _ in told], axis=1).astype(np.uint8).tobytes()
                code = pa.array([codes[i : i + parts] for i in range(0, len(codes), parts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], code, pa.array(sum(d for _, d in told), pa.int64())], names=[*names, "code", "error"])

        schema = "".join(f"{c} {kinds[c]}, " for c in names) + "code binary, error long"
        own = self.kept.select(*names, "__vector")
        found = own.mapInArrow(run, schema) if self.codebooks else self.spark.createDataFrame([], schema)
        return found.toDF(self.id, *self.keep, "code", "error")


def with_label_errors(rows: DataFrame, label_col: str = "label", error_col: str = "error") -> DataFrame:
    """rows with label_error, the sum of error over the rows of a label (nulls together; null beyond a long). rows are
    read twice. A label of any number of rows is summed before the shuffle."""
    total = rows.groupBy(F.col(f"`{label_col}`").alias("__label")).agg(F.try_sum(F.col(f"`{error_col}`")).alias("label_error"))
    return rows.join(total, F.col(f"`{label_col}`").eqNullSafe(F.col("__label")), "left").drop("__label")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """All embeddings in four parts of 256 entries, after four rounds; the contract's columns."""
    codes = VectorCodes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=("label",))
    rows = written(codes.rows(), "vector-codes")
    told = with_label_errors(rows)
    return told.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
