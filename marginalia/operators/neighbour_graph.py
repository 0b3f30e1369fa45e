"""An index for nearest neighbours: a graph that links each vector with its nearest ones, built by dealings and neighbour
descent, and a search that walks it for all queries at once.

build() deals the vectors DEALS times to groups of about DEALT that lie near each other (the leaves of a tree of random
planes, fitted to a bounded sample), and compares each group's members with one another. A vector takes its list along, so
a dealing sends it once. Then it refines: the neighbours of a vector are compared with one another, and each keeps what is
nearer than its worst; lists whose vectors share a leaf are compared in one place, to which a member is sent once. Lists are
bounded (k forward, k of those that point back), so nothing grows with a hub, and only improvements leave a group. Vectors
are compared as floats of 32 bits and scores kept to 7 places.

search() keeps for each query the `beam` best vectors met so far; a round follows the links of those not yet followed,
for all queries in one join, and scores what no round has met. It ends when all of every beam is followed. A query needs
no place in the graph. What is compared is a small share of all pairs that falls with the number of vectors.

Cosine similarity; a vector of length 0 has similarity 0 with all. Of several rows with one id the first by content counts;
vectors must be of one dimension (guarded() sees to it). Fewer than k + 1 vectors: lists are shorter. All tables of
iterations are written to the shared folder and deleted once they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Scratch

K, LINKS, BEAM, STARTS, ROUNDS = 32, 32, 48, 8, 12
DEALS, DEALT = 24, 2048  # times that vectors are dealt to groups at first, and vectors in a group, about
SAMPLE, EACH = 65_536, 32  # vectors at most that a tree is fitted to, and those of them in a leaf, about
TASKS = 512  # that compare groups, at most
ROWS = 512  # rows of a group that are compared at once
BLOCK = 32_768  # vectors whose lists one task brings up to date
UNIT = 10_000_000  # scores are kept as whole numbers of this part
SETTLED = 0.005  # a round that changes a smaller share of all links is the last one
MOST_EACH = 6  # improvements of a vector that one list tells at most
NONE = -(2**31)  # the score of no neighbour


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(vectors: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id long, vec) with vectors of length 1, or 0."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1))
            size = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
            flat = pa.array(v.ravel())
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (v.shape[1] if len(v) else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, flat)], names=["id", "vec"])

    return own.groupBy("id").agg(F.min("vec").alias("vec")).mapInArrow(run, "id long, vec array<double>")


_STATE = "id long, vec binary, near binary, score binary, g int"


def _floats(column: pa.ChunkedArray | pa.Array, kind: type, width: int) -> np.ndarray:
    """A matrix of rows that are kept as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


class _Tree:
    """Random planes that halve a sample again and again, each through two of its vectors, and from them groups of about
    `dealt` of n vectors. What planes don't tell apart, such as copies, is dealt by id."""

    def __init__(self, sample: np.ndarray, n: int, seed: int, dealt: int):
        pick = np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1, min(n / dealt, len(sample) / EACH))))))
        self.planes, self.cuts = np.zeros((2**self.depth - 1, sample.shape[1])), np.zeros(2**self.depth - 1)
        at = [np.arange(len(sample))]
        for node in range(2**self.depth - 1):
            own = sample[at[node]]
            if len(own) > 1:
                x, y = pick.choice(len(own), 2, replace=False)
                self.planes[node] = own[x] - own[y]
            side = own @ self.planes[node]
            self.cuts[node] = np.median(side) if len(own) else 0.0
            at += [at[node][side <= self.cuts[node]], at[node][side > self.cuts[node]]]
        sizes = np.array([len(x) for x in at[2**self.depth - 1 :]])
        self.parts = np.maximum(1, np.ceil(sizes / max(1, len(sample)) * n / dealt - 0.5)).astype(np.int64)
        self.first = np.cumsum(self.parts) - self.parts

    def groups(self, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        node = np.zeros(len(ids), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((v * self.planes[node]).sum(axis=1) > self.cuts[node])
        leaf = node - (2**self.depth - 1)
        chance = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return (self.first[leaf] + chance % self.parts[leaf]).astype(np.int32)


def _merged(near: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties by id, of neighbours that a row may have twice."""
    o = np.argsort(near, axis=1, kind="stable")
    near, score = np.take_along_axis(near, o, 1), np.take_along_axis(score, o, 1)
    score[:, 1:][near[:, 1:] == near[:, :-1]] = NONE
    o = np.lexsort((near, -score.astype(np.int64)), axis=1)[:, :k]
    return np.take_along_axis(near, o, 1), np.take_along_axis(score, o, 1)


def _whole(s: np.ndarray) -> np.ndarray:
    return np.rint(s * UNIT).astype(np.int32)


def _dealt(k: int, dim: int, after: _Tree):
    """The lists of a group's members once these are compared with one another, and the groups of the next dealing."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, v = table["id"].to_numpy(), _floats(table["vec"], np.float32, dim).astype(np.float64)
        near, score = _floats(table["near"], np.int64, k).copy(), _floats(table["score"], np.int32, k).copy()
        m = min(k, len(ids) - 1)
        for at in range(0, len(ids) if m > 0 else 0, ROWS):
            s = v[at : at + ROWS] @ v.T
            i = np.arange(len(s))
            s[i, at + i] = -np.inf
            top = np.argpartition(s, len(ids) - m, axis=1)[:, len(ids) - m :]
            found = _whole(np.take_along_axis(s, top, 1))
            rows = slice(at, at + len(s))
            near[rows], score[rows] = _merged(np.hstack([near[rows], ids[top]]), np.hstack([score[rows], found]), k)
        return pa.table({"id": ids, "vec": table["vec"], "near": _bytes(near), "score": _bytes(score), "g": after.groups(ids, v)})

    return run


_SCORED = "source long, target long, score int"


def _compared(k: int, dim: int):
    """For each list of a group (list, id) the pairs of its members (member, vec, worst) that are nearer than a member's worst
    neighbour so far, of the group k a member at most."""

    def run(lists: pa.Table, members: pa.Table) -> pa.Table:
        members = members.sort_by("member")
        known, worst = members["member"].to_numpy(), members["worst"].to_numpy()
        v = _floats(members["vec"], np.float32, dim).astype(np.float64)
        lists = lists.sort_by([("list", "ascending"), ("id", "ascending")])
        of, at = lists["list"].to_numpy(), np.searchsorted(known, lists["id"].to_numpy())
        edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(1, np.int64)
        a, b, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y - x < 2:
                continue
            own = at[x:y]
            s = _whole(v[own] @ v[own].T)
            s[s <= worst[own, None]] = NONE
            np.fill_diagonal(s, NONE)
            m = min(MOST_EACH, y - x - 1)
            top = np.argpartition(s, y - x - m, axis=1)[:, y - x - m :]
            found = np.take_along_axis(s, top, 1)
            i, j = np.nonzero(found > NONE)
            a.append(own[i]), b.append(own[top[i, j]]), scores.append(found[i, j])
        a, b, scores = np.concatenate(a), np.concatenate(b), np.concatenate(scores)
        _, once = np.unique(a * max(1, len(known)) + b, return_index=True)
        a, b, scores = a[once], b[once], scores[once]
        o = np.lexsort((b, -scores.astype(np.int64), a))
        a, b, scores = a[o], b[o], scores[o]
        few = np.arange(len(a)) - np.searchsorted(a, a) < k
        return pa.table({"source": known[a[few]], "target": known[b[few]], "score": scores[few]})

    return run


def _improved(k: int):
    """Lists (state) with what was found (source, target, score), and how many of a list's links are new."""

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        state = state.sort_by("id")
        ids = state["id"].to_numpy()
        near, score = _floats(state["near"], np.int64, k).copy(), _floats(state["score"], np.int32, k).copy()
        found = found.sort_by([("source", "ascending"), ("score", "descending"), ("target", "ascending")])
        source, target, s = (found[c].to_numpy() for c in ("source", "target", "score"))
        told = np.ones(len(source), bool)
        told[1:] = (source[1:] != source[:-1]) | (target[1:] != target[:-1])
        source, target, s = source[told], target[told], s[told]
        turn = np.arange(len(source)) - np.searchsorted(source, source)
        source, target, s, turn = (x[turn < k] for x in (source, target, s, turn))
        row = np.searchsorted(ids, source)
        more, better = np.full_like(near, -1), np.full_like(score, NONE)
        more[row, turn], better[row, turn] = target, s
        before = near.copy()
        some = np.unique(row)
        near[some], score[some] = _merged(np.hstack([near[some], more[some]]), np.hstack([score[some], better[some]]), k)
        changed = np.zeros(len(ids), np.int32)
        for r in some:
            changed[r] = np.count_nonzero(~np.isin(near[r], before[r]))
        return pa.table({"id": ids, "vec": state["vec"], "near": _bytes(near), "score": _bytes(score), "g": state["g"], "changed": changed})

    return run


def _links(state: DataFrame, k: int) -> DataFrame:
    """(source, target, score, g) of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, score = _floats(batch.column(1), np.int64, k), _floats(batch.column(2), np.int32, k)
            i, j = np.nonzero(score > NONE)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(near[i, j]), pa.array(score[i, j] / UNIT), batch.column(3).take(pa.array(i))], names=["source", "target", "score", "g"])

    return state.select("id", "near", "score", "g").mapInArrow(run, "source long, target long, score double, g int")


def _lists(graph: DataFrame, k: int, turn: int) -> DataFrame:
    """(list, id): of each vector those that it points to, and k by chance of those that point to it."""
    back = graph.select(F.col("target").alias("list"), F.col("source").alias("id"))
    some = back.withColumn("r", F.row_number().over(Window.partitionBy("list").orderBy(F.xxhash64("id", F.lit(turn)), "id"))).where(F.col("r") <= k).drop("r")
    return graph.select(F.col("source").alias("list"), F.col("target").alias("id")).union(some).distinct()


def build(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, id_col: str = "id", vec_col: str = "vec", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph (source, target, score), k links a vector at most, and the vectors (id, vec) to unit length, as tables of
    the shared folder."""
    own = Scratch(vectors.sparkSession) if scratch is None else scratch
    v = own.write(unit(vectors, id_col, vec_col), "unit-vectors")
    n, dim = v.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    dealt, deals = DEALT, DEALS if n > DEALT else 1
    some = v.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 2 * EACH * -(-n // dealt))).select("vec").toArrow() if deals > 1 else None
    sample = _matrix(some["vec"]) if some is not None else np.zeros((0, dim))
    trees = [_Tree(sample, n if deals > 1 else 1, seed, dealt) for seed in range(deals + 1)]

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = trees[0]
        for batch in batches:
            ids, x, size = batch.column(0).to_numpy(), _matrix(batch.column(1)).astype(np.float32), batch.num_rows
            empty = pa.array([np.full(k, -1, np.int64).tobytes()] * size, pa.binary()), pa.array([np.full(k, NONE, np.int32).tobytes()] * size, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(x), *empty, pa.array(first.groups(ids, x) if size else np.zeros(0, np.int32))], names=["id", "vec", "near", "score", "g"])

    tasks = int(min(TASKS, max(tree.parts.sum() for tree in trees)))
    state = v.mapInArrow(begun, _STATE)
    for tree in trees[1:]:
        state = state.repartition(tasks, "g").groupBy("g").applyInArrow(_dealt(k, dim, tree), _STATE)
    state = own.write(state, "neighbours")
    blocks = F.pmod(F.xxhash64("id"), F.lit(max(1, n // BLOCK))).cast("int")
    for turn in range(rounds if deals > 1 else 0):
        places = state.select(F.col("id").alias("list"), "g")
        lists = own.write(_lists(_links(state, k), k, turn).join(places, "list"), "lists")
        least = F.conv(F.hex(F.reverse(F.substring("score", 4 * k - 3, 4))), 16, 10).cast("long")  # little-endian
        told = state.select(F.col("id").alias("member"), "vec", F.when(least >= 2**31, least - 2**32).otherwise(least).cast("int").alias("worst"))
        members = lists.select(F.col("g").alias("to"), F.col("id").alias("member")).distinct().join(told, "member").repartition(tasks, "to")
        found = lists.repartition(tasks, "g").groupBy("g").cogroup(members.groupBy("to")).applyInArrow(_compared(k, dim), _SCORED)
        found = found.withColumnRenamed("source", "id").select(F.col("id").alias("source"), "target", "score", blocks.alias("to"))
        after = state.withColumn("b", blocks).groupBy("b").cogroup(found.groupBy("to")).applyInArrow(_improved(k), f"{_STATE}, changed int")
        after = own.write(after, "neighbours")
        changed = after.agg(F.coalesce(F.sum("changed"), F.lit(0))).first()[0]
        own.drop(state, lists)
        state = after
        if changed <= SETTLED * k * n:
            break
    graph = own.write(_links(state, k).drop("g"), "links")
    own.drop(state)
    return graph, v


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = (_matrix(batch.column(2)) * _matrix(batch.column(3))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["q", "node", "score"])


def search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, links: int = LINKS, beam: int = BEAM, starts: int = STARTS, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(source, target, score, rank, scored): the k nearest that a walk over build()'s graph finds for each query (id_col,
    vec_col), and how many vectors the query was compared with. Of each vector's links the `links` nearest are followed, and
    as many by chance of those that point to it. A query that is a vector itself finds itself too."""
    scratch = Scratch(graph.sparkSession)
    beam = max(beam, k)
    q = scratch.write(unit(queries, id_col, vec_col).select(F.col("id").alias("q"), F.col("vec").alias("qv")), "queries")
    nearest = graph.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))).where(F.col("r") <= links)
    near = scratch.write(_lists(nearest, links, 0).groupBy(F.col("list").alias("node")).agg(F.collect_list("id").alias("near")), "links")
    entry = vectors.orderBy(F.xxhash64("id"), "id").limit(starts).collect()  # `starts` vectors
    ids, at = np.array([r.id for r in entry], np.int64), np.array([r.vec for r in entry])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            s = _matrix(batch.column(1)) @ at.T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(ids)))), pa.array(np.tile(ids, batch.num_rows)), pa.array(s.ravel())], names=["q", "node", "score"])

    scored = "q long, node long, score double"
    met = [scratch.write(q.mapInArrow(enter, scored), "met")]
    by = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    best = scratch.write(met[0].withColumn("r", F.row_number().over(by)).where(F.col("r") <= beam).select("q", "node", "score", F.lit(False).alias("followed")), "beam")
    while not (ahead := best.where("not followed")).isEmpty():
        seen = met[0].select("q", "node")
        for m in met[1:]:
            seen = seen.union(m.select("q", "node"))
        step = ahead.select("q", "node").join(near, "node").select("q", F.explode("near").alias("node")).distinct().join(seen, ["q", "node"], "left_anti")
        pairs = step.join(vectors.select(F.col("id").alias("node"), "vec"), "node").join(q, "q").select("q", "node", "vec", "qv")
        met.append(scratch.write(pairs.mapInArrow(_dots, scored), "met"))
        every = best.select("q", "node", "score", F.lit(True).alias("followed")).unionByName(met[-1].withColumn("followed", F.lit(False)))
        after = scratch.write(every.withColumn("r", F.row_number().over(by)).where(F.col("r") <= beam).drop("r"), "beam")
        scratch.drop(best)
        best = after
    every = met[0]
    for m in met[1:]:
        every = every.union(m)
    counts = every.groupBy("q").agg(F.count(F.lit(1)).alias("scored"))
    out = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).join(counts, "q")
    return scratch.result(out.select(F.col("q").alias("source"), F.col("node").alias("target"), "score", "rank", "scored"), "graph-search")


def index(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(source, target, score, rank), for retrieval.edges_of(index=...): neighbours by the graph, without comparing all. Where
    the queries are the vectors, the graph's own lists are the answer."""
    graph, unit_vectors = build(vectors, max(K, k))
    if queries is not vectors:
        return search(graph, unit_vectors, queries, k).drop("scored")
    return graph.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))).where(F.col("rank") <= k)
