"""Property graphs as vertex and edge tables. Iterations write their state to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Scratch
from . import walks

MOST_ENDS, PIVOTS = 20_000_000, 16
SMALL = 100_000  # pairs that one task decides
HELD, FEW_SEARCHES, RESTARTS = 256_000_000, 64, 10_000  # bytes of bits of searches that go at once; searches whose finds are noted; parts that are put in order
PART = 1 << 16  # vertices whose edges a walk keeps in one row
SEEN, GATHERED = 32_000_000, 8_000_000  # bytes of the searches that a task runs at once, and of the rows it unites at once
SUMMED = 1_000_000  # bytes of the rows it adds up at once
PIECE, LAID, FEWEST = 32, 512, 64  # neighbours of a vertex that are added one by one; vertices for which this is done at once, at most, and at least


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select("source", "target").union(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return both.where("source <> target").distinct()


def degree(edges: DataFrame) -> DataFrame:
    """Edge ends at each vertex, loops left out."""
    e = edges.where("source <> target")
    return e.select(F.col("source").alias("id")).union(e.select(F.col("target").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, vertex, direction: str = "both") -> DataFrame:
    """(id, weight) of a vertex's neighbours; of several edges the first by type and weight counts."""
    out = edges.where(F.col("source") == vertex).select(F.col("target").alias("id"), "type", "weight")
    into = edges.where(F.col("target") == vertex).select(F.col("source").alias("id"), "type", "weight")
    rows = out if direction == "out" else into if direction == "in" else out.union(into)
    return rows.groupBy("id").agg(F.min(F.struct("type", "weight")).alias("e")).select("id", "e.type", "e.weight")


def parents(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, parent, type) over edges of a type, or of all."""
    rows = edges if kind is None else edges.where(F.col("type") == kind)
    return rows.select(F.col("target").alias("id"), F.col("source").alias("parent"), "type").distinct()


def children(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, child, type) over edges of a type, or of all."""
    rows = edges if kind is None else edges.where(F.col("type") == kind)
    return rows.select(F.col("source").alias("id"), F.col("target").alias("child"), "type").distinct()


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ids."""
    s = ids.select("id").distinct()
    a = edges.join(s.withColumnRenamed("id", "source"), "source", "left_semi").select(*edges.columns)
    return a.union(edges.join(s.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)).distinct()


def _place(d: str, i: str) -> Column:
    return F.struct(F.col(d).alias("d"), F.col(i).alias("i"))


def _paths(led: DataFrame) -> DataFrame:
    """(u, v, w): pairs of edges (u, v, d: the degree of v) of one u to a lower v and a higher w. The edge to v is taken only
    where v leads on to any other: the others (the hubs of a graph of two kinds) can't have a third side."""
    onward = led.join(led.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return onward.join(led.select("u", F.col("v").alias("w"), F.col("d").alias("e")), "u").where(_place("d", "v") < _place("e", "w")).select("u", "v", "w")


def common_ratio(edges: DataFrame) -> DataFrame:
    """(a, b, ratio) for adjacent a < b: common neighbours over the larger degree. Each edge leads from its end of lower
    degree (of equal ones the smaller id), so that a hub has few edges of its own, and each triangle is met once, at its
    lowest corner: as paths of two such edges whose ends are joined by a third."""
    scratch = Scratch(edges.sparkSession)
    near = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    near = scratch.write(near.distinct(), "ratio-pairs")
    deg = near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = scratch.write(near.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b"), "ratio-edges")
    up = _place("da", "a") < _place("db", "b")
    led = both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"), F.greatest("da", "db").alias("d"))
    two = _paths(led)
    met = two.join(led.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    sides = F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("u", "v"), ("u", "w"), ("v", "w"))])
    common = met.select(F.inline(sides)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    out = both.join(common, ["a", "b"], "left").select("a", "b", (F.coalesce("common", F.lit(0)) / F.greatest("da", "db")).alias("ratio"))
    return scratch.result(out, "ratios")


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 10) -> DataFrame:
    """(id, rank) after a fixed number of iterations; what vertices without outgoing edges hold goes to all alike. Ranks are
    written after each iteration, so that the plan of one doesn't hold those before it."""
    scratch = Scratch(edges.sparkSession)
    n = vertices.count()
    out = edges.groupBy("source").agg(F.count(F.lit(1)).alias("d"))
    e = scratch.write(edges.join(out, "source").select("source", "target", "d"), "rank-edges")
    v = scratch.write(vertices.select("id").join(out.withColumnRenamed("source", "id"), "id", "left").select("id", "d"), "rank-vertices")
    ranks = v.select("id", "d", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(iterations):
        before = ranks
        lost = ranks.where("d is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("l"))
        gained = ranks.select(F.col("id").alias("source"), "rank").join(e, "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("d")).alias("g"))
        ranks = scratch.write(v.join(gained, "id", "left").select("id", "d", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("g", F.lit(0.0)) + lost.scalar() / n)).alias("rank")), "ranks")
        scratch.drop(before)
    return scratch.result(ranks.select("id", "rank"), "ranks")


def _numbered(vertices: DataFrame, scratch: Scratch) -> DataFrame:
    """Vertices (id, ...) with numbers n from 0 on, those of a part from `first` on, `size` of them."""
    parts = max(1, vertices.count() // PART)
    placed = vertices.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    placed = scratch.write(placed.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1), "vertices")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).cast("int").alias("size"))
    sizes = sizes.withColumn("first", F.sum("size").over(Window.orderBy("part")) - F.col("size"))  # a row for each part
    return scratch.write(placed.join(F.broadcast(sizes), "part").withColumn("n", F.col("first") + F.col("at")).drop("at"), "places")


def walk(seeds: DataFrame, edges: DataFrame, steps: int = 100, restart: float = 0.15) -> DataFrame:
    """(id, score): the expected share of time that walks spend at each vertex. Walks start at the seeds (id, score),
    restart at their own seed with probability `restart` or where no edge leaves, else follow an out-edge in proportion
    to weight. Edges run both ways (a vertex without any is its own seed), so one vector for all seeds is enough. The edges
    are kept as arrays, a row for the vertices of a part, and dealt once (walks.py)."""
    spark = edges.sparkSession
    scratch = Scratch(spark)
    e = scratch.write(edges.select("source", "target", F.col("weight").cast("double").alias("weight")), "walk-edges")
    start = scratch.write(seeds.select("id", F.col("score").cast("double").alias("p")), "walk-seeds")
    total = e.groupBy(F.col("source").alias("id")).agg(F.sum("weight").alias("total"))
    every = e.select(F.col("target").alias("id")).union(start.select("id")).distinct().join(total, "id", "full")
    ids = _numbered(every, scratch)
    links = scratch.write(walks.over(e, ids), "walk-links")
    held = ids.join(start, "id").groupBy("n").agg(F.sum("p").alias("p"), F.first("total").alias("total")).toArrow()  # as many as seeds
    at, weights = held["n"].to_numpy(), ids.where("total is not null").select("n", "total").toArrow()
    mass, totals, alone = np.zeros(ids.count()), np.zeros(ids.count()), np.zeros(ids.count(), bool)
    mass[at], totals[weights["n"].to_numpy()], alone[at] = held["p"].to_numpy(), weights["total"].to_numpy(), held["total"].is_null().to_numpy()
    score, met = walks.walked(links, totals, mass, at, alone, steps, restart)
    shared = spark.sparkContext.broadcast((score, met))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, met = shared.value
        for batch in batches:
            n = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score[n])], names=["id", "score"]).filter(pa.array(met[n]))

    return scratch.result(ids.select("id", "n").mapInArrow(told, f"id {ids.schema['id'].dataType.simpleString()}, score double"), "walk")


def shortest_paths(edges: DataFrame, start) -> DataFrame:
    """(id, depth, parent): breadth-first from a vertex over undirected edges, until no vertex is new; of several parents
    the smallest. Levels are tables of their own: what a level meets is new, or in it or the one before."""
    scratch = Scratch(edges.sparkSession)
    u = scratch.write(undirected(edges), "path-edges")
    kind = u.schema["source"].dataType
    levels = [scratch.write(u.select(F.lit(start).cast(kind).alias("id"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")).limit(1), "path")]
    while not levels[-1].isEmpty():
        step = levels[-1].select(F.col("id").alias("source")).join(u, "source").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
        seen = reduce(DataFrame.union, [level.select("id") for level in levels[-2:]])
        levels.append(scratch.write(step.join(seen, "id", "left_anti").select("id", F.lit(len(levels)).alias("depth"), "parent"), "path"))
    return scratch.result(reduce(DataFrame.union, levels), "path")


def path_nodes(paths: DataFrame, target) -> DataFrame:
    """(step, id) of the way that shortest_paths() found to a vertex, from its start on; no rows if there is none."""
    at = paths.where(F.col("id") == target).select("depth", "id", "parent").first()
    spark, kind = paths.sparkSession, paths.schema["id"].dataType.simpleString()
    steps = []
    while at is not None:  # one row a step: as many as the path is long
        steps.append((at.depth, at.id))
        at = None if at.parent is None else paths.where(F.col("id") == at.parent).select("depth", "id", "parent").first()
    return spark.createDataFrame(steps[::-1], f"step int, id {kind}")


class _Searches:
    """Breadth-first searches over an adjacency in arrays, a level at a time (Brandes), from several vertices at once: a column
    of a matrix each, so that an edge is looked up once for all of them."""

    def __init__(self, starts: np.ndarray, targets: np.ndarray):
        self.starts, self.targets, self.n = starts, targets, len(starts) - 1
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(starts))
        self.lean = np.zeros(self.n)
        self.most = int(np.clip(SEEN // (8 * max(self.n, 1)), 1, 128))
        self._lay()

    def _lay(self) -> None:
        """Lays the neighbours out in pieces: of many vertices at once (with most neighbours first) their first ones, their second
        ones and so on, as far as there are many; `rest` are the edges of vertices with more neighbours than most."""
        degree, self.pieces, done = np.diff(self.starts), [], 0
        while len(owners := np.flatnonzero(degree > done)) >= FEWEST:
            length = np.minimum(degree[owners] - done, PIECE)
            order = np.argsort(-length, kind="stable")
            for c in range(0, len(owners), LAID):
                some, long = owners[order[c : c + LAID]], length[order[c : c + LAID]]
                at = self.starts[some] + done
                self.pieces.append((some, [self.targets[at[: np.count_nonzero(long > k)] + k] for k in range(long[0])]))
            done += PIECE
        self.rest = np.flatnonzero(np.arange(len(self.targets)) - self.starts[self.rows] >= done)

    def _sums(self, given: np.ndarray, live: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """For each vertex asked the sum of the rows of its neighbours, of which those that are not live hold 0; for others 0 or
        the same. Of few edges each is looked up, else all of them, as they are laid out."""
        out = np.zeros_like(given)
        ends = np.flatnonzero(live[self.targets] & asked[self.rows])
        if len(ends) > len(self.targets) // 8:
            ends, total, row = self.rest, np.empty((LAID, given.shape[1])), np.empty((LAID, given.shape[1]))
            for owners, near in self.pieces:
                if asked[owners].any():
                    own = np.take(given, near[0], axis=0, out=total[: len(owners)], mode="clip")
                    for some in near[1:]:
                        own[: len(some)] += np.take(given, some, axis=0, out=row[: len(some)], mode="clip")
                    out[owners] += own
        step = max(1, SUMMED // given[:1].nbytes)
        for at in range(0, len(ends), step):
            some = ends[at : at + step]
            rows = self.rows[some]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            out[rows[first]] += np.add.reduceat(given[self.targets[some]], first, axis=0)
        return out

    def alike(self) -> list[np.ndarray]:
        """The vertices in groups that have just the same neighbours."""
        groups: dict[bytes, list[int]] = {}
        for v, (a, b) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            groups.setdefault(self.targets[a:b].tobytes(), []).append(v)
        return [np.array(g) for g in groups.values()]

    def run(self, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Adds to `lean` what depends on each vertex for the paths from groups of vertices with the same neighbours, at most
        `most` of them, by one search from the first of each; closeness and harmonic closeness of each group's. Any two of a
        group may change places, so each gives the same to a vertex outside it, and to another in it what the first gives to any."""
        own = (np.array([g[0] for g in groups]), np.arange(len(groups)))
        depth, paths = np.full((self.n, len(groups)), -1, np.int32), np.zeros((self.n, len(groups)))
        depth[own], paths[own] = 0, 1.0
        front, steps, far, near = paths.copy(), 0, np.zeros(len(groups)), np.zeros(len(groups))
        while True:
            open_ = depth < 0
            front = self._sums(front, front.any(axis=1), open_.any(axis=1))
            front *= open_
            new = front > 0
            if not (found := np.count_nonzero(new, axis=0)).any():
                break
            steps += 1
            np.putmask(depth, new, steps)
            paths += front
            far += found * steps
            near += found / steps
        lean, share = np.zeros_like(paths), np.empty_like(paths)
        for step in range(steps, 1, -1):
            here, above = depth == step, depth == step - 1
            share.fill(0.0)
            np.divide(1 + lean, paths, out=share, where=here)
            given = self._sums(share, here.any(axis=1), above.any(axis=1))
            given *= paths
            given *= above
            lean += given
        self.lean += lean @ np.array([len(g) for g in groups], float)
        for i, group in enumerate(groups):
            if len(group) > 1:
                self.lean[group] += lean[group[-1], i] * (len(group) - 1) - lean[group, i] * len(group)
        return np.divide(1.0, far, out=np.zeros_like(far), where=far > 0), near


def _adjacency(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray, np.ndarray, pa.Array]:
    """The undirected edges, and as arrays where each vertex's neighbours start, the neighbours, and the sorted names."""
    u = scratch.write(undirected(edges), "central-edges")
    if (size := u.count()) > MOST_ENDS:
        scratch.close()
        raise ValueError(f"{size} edge ends are too many for exact centralities: use sampled_centralities()")
    kind = dict(u.dtypes)["source"]
    ids = scratch.write(u.select(F.col("source").alias("id")).distinct(), "central-vertices")
    named = ids.toArrow()["id"].combine_chunks() if size else pa.array([], pa.int64())
    named = named.take(pc.sort_indices(named))
    ends = u.toArrow() if size else None
    at = [pc.index_in(ends[c], named).to_numpy() for c in ("source", "target")] if size else [np.zeros(0, np.int64)] * 2
    order = np.lexsort((at[1], at[0]))
    starts = np.append(0, np.cumsum(np.bincount(at[0], minlength=len(named)))).astype(np.int64)
    return u, starts, at[1][order].astype(np.int32), named


def centralities(edges: DataFrame) -> DataFrame:
    """(id, betweenness, closeness, harmonic) of an undirected graph, exact: one breadth-first search from each vertex, and
    from only one of those that have the same neighbours (such as the leaves of one parent), the sources spread over tasks. Each task needs the adjacency, so its size is measured: over MOST_ENDS edge ends (4 bytes
    each) this is an error, and sketched_closeness() or sampled_centralities(), which estimate, are to be asked for by name."""
    scratch = Scratch(edges.sparkSession)
    u, starts, targets, named = _adjacency(edges, scratch)
    kind = dict(u.dtypes)["source"]
    searches = _Searches(starts, targets)
    groups, most = searches.alike(), searches.most
    first = np.append(0, np.cumsum([len(g) for g in groups])).astype(np.int64)
    shared = u.sparkSession.sparkContext.broadcast((starts, targets, named, first, np.concatenate([*groups, np.zeros(0, np.int64)]).astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, targets, named, first, members = shared.value
        found, here, close, near = _Searches(starts, targets), [], [], []
        for batch in batches:
            for lot in batch.column(0).to_pylist():
                groups = [members[first[g] : first[g + 1]] for g in range(lot * most, min(len(first) - 1, (lot + 1) * most))]
                sizes, (c, h) = [len(g) for g in groups], found.run(groups)
                here += groups
                close.append(np.repeat(c, sizes)), near.append(np.repeat(h, sizes))
        lean = np.flatnonzero(found.lean)
        none, told = np.zeros(len(lean)), np.concatenate([np.zeros(0, np.int64), *here])
        yield pa.RecordBatch.from_arrays([named.take(pa.array(np.append(lean, told).astype(np.int64))), pa.array(np.append(found.lean[lean] / 2, np.zeros(len(told)))), pa.array(np.concatenate([none, *close])), pa.array(np.concatenate([none, *near]))], names=["id", "b", "c", "h"])

    lots = -(-len(groups) // most)
    parts = max(1, min(lots, u.sparkSession.sparkContext.defaultParallelism * 4))
    out = u.sparkSession.range(0, lots, 1, parts).mapInArrow(run, f"id {kind}, b double, c double, h double").groupBy("id").agg(F.sum("b").alias("betweenness"), F.sum("c").alias("closeness"), F.sum("h").alias("harmonic"))
    return scratch.result(out, "centralities")


def _adjacent(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(first, degrees, targets): a row for each part of the vertices, with the numbers of their neighbours as 32-bit integers,
    whichever way an edge runs and however often it is there."""

    def run(table: pa.Table) -> pa.Table:
        first, size = table["first"][0].as_py(), table["size"][0].as_py()
        both = np.unique((table["s"].to_numpy() - first) << 32 | table["t"].to_numpy())
        degrees = np.bincount(both >> 32, minlength=size).astype(np.int32)
        return pa.table({"first": pa.array([first]), "degrees": pa.array([degrees.tobytes()], pa.binary()), "targets": pa.array([both.astype(np.int32).tobytes()], pa.binary())})

    ends = edges.select("source", "target")
    for end in ("source", "target"):
        ends = ends.join(ids.select(F.col("id").alias(end), F.struct("n", "part", "first", "size").alias(f"{end}_at")), end)
    each = F.array(*[F.struct(F.col(f"{x}_at.n").alias("s"), F.col(f"{y}_at.n").alias("t"), *[F.col(f"{x}_at.{c}").alias(c) for c in ("part", "first", "size")]) for x, y in (("source", "target"), ("target", "source"))])
    return ends.select(F.inline(each)).groupBy("part").applyInArrow(run, "first long, degrees binary, targets binary")


def _united(given: np.ndarray, starts: np.ndarray, targets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each of some vertices the "or" of the rows of its neighbours: where rows are wide, one neighbour of many vertices
    after the other, with most neighbours first, as far as there are many."""
    if given.shape[1] < 8 or len(rows) < FEWEST:
        ends, first = _ends(starts, rows)
        return np.bitwise_or.reduceat(given[targets[ends]], first, axis=0)
    size = starts[rows + 1] - starts[rows]
    order = np.argsort(-size, kind="stable")
    out, row = np.empty((len(rows), given.shape[1]), np.uint64), np.empty((LAID, given.shape[1]), np.uint64)
    for c in range(0, len(rows), LAID):
        some = order[c : c + LAID]
        at, long = starts[rows[some]], size[some]
        own, many = given[targets[at]], int(long[min(FEWEST, len(some)) - 1])
        for k in range(1, many):
            m = int(np.searchsorted(-long, -k))  # as many have more than k
            own[:m] |= np.take(given, targets[at[:m] + k], axis=0, out=row[:m], mode="clip")
        for k in np.flatnonzero(long > many).tolist():
            for x in range(at[k] + many, at[k] + long[k], LAID):
                own[k] |= np.bitwise_or.reduce(given[targets[x : min(x + LAID, at[k] + long[k])]], axis=0)
        out[some] = own
    return out


def _ends(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the neighbours of some vertices are, and where each vertex's begin among these."""
    size = starts[rows + 1] - starts[rows]
    stop = np.cumsum(size)
    return np.repeat(starts[rows] - (stop - size), size) + np.arange(stop[-1] if len(rows) else 0), stop - size


class _Reach:
    """How many vertices a breadth-first search finds at each distance, from many vertices at once: a bit each, so that a level
    is one "or" of words over the edges of what it meets. Vertices are put in the order of a search, so that those taken
    together lie together. Searches that have seen the same vertices and stand at the same ones find the same from there on:
    they go on as one, and what was found from there before is taken. That they are the same is told by 128 parities. Where they
    meet so many vertices that their bits take more than HELD bytes, fewer go at once."""

    def __init__(self, starts: np.ndarray, targets: np.ndarray):
        n = len(starts) - 1
        found, order, restarts, free = np.zeros(n, bool), [], 0, 0
        while free < n and restarts < RESTARTS:
            rest = np.flatnonzero(~found[free : free + 4096])
            if not len(rest):
                free += 4096
                continue
            restarts, free = restarts + 1, free + int(rest[0])
            level = np.array([free])
            while len(level):
                found[level] = True
                order.append(level)
                near = targets[_ends(starts, level)[0]]
                level = np.unique(near[~found[near]])
        order.append(np.flatnonzero(~found))
        self.order = np.concatenate(order)
        rank = np.empty(n, np.int32)
        rank[self.order] = np.arange(n, dtype=np.int32)
        self.n, self.starts = n, np.append(0, np.cumsum((starts[1:] - starts[:-1])[self.order]))
        self.targets = np.empty_like(targets)
        for at in range(0, n, 1 << 16):
            rows = self.order[at : at + (1 << 16)]
            self.targets[self.starts[at] : self.starts[min(n, at + (1 << 16))]] = rank[targets[_ends(starts, rows)[0]]]
        self.bytes = np.random.default_rng(7).integers(0, 256, (8, n), np.uint8)  # a vertex's part in 64 parities
        self.known: dict[bytes, tuple[list[int], int]] = {}

    def _parities(self, rows: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Of each search 64 parities of the vertices that it has among these rows."""
        out = np.zeros((64, bits.shape[1]), np.uint64)
        for g in range(8):
            value = self.bytes[g][rows]
            by = np.argsort(value, kind="stable")
            values, first = np.unique(value[by], return_index=True)
            sums = np.bitwise_xor.reduceat(bits[by], first, axis=0)
            for k in range(8):
                out[8 * g + k] = np.bitwise_xor.reduce(sums[(values >> k & 1) > 0], axis=0)
        each = np.unpackbits(out.view(np.uint8), axis=1, bitorder="little")
        return np.packbits(each, axis=0).T.copy().view(np.uint64).ravel()

    def _step(self, live: np.ndarray, front: np.ndarray, seen: np.ndarray, full: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vertices that are found next, and by which searches."""
        mark = np.zeros(self.n, bool)
        mark[self.targets[_ends(self.starts, live)[0]]] = True
        met = np.flatnonzero(mark & ~done)
        rows, bits = [live[:0]], [front[:0]]
        size = np.cumsum(self.starts[met + 1] - self.starts[met])
        gathered = GATHERED if front.shape[1] < 8 else 32 * GATHERED  # of wide rows few are held at once
        cuts = np.searchsorted(size, np.arange(0, size[-1] if len(met) else 0, max(1, gathered // (8 * front.shape[1]))), "right")
        for some in np.split(met, np.unique(cuts)):
            if len(some):
                new = _united(front, self.starts, self.targets, some) & ~seen[some]
                there = new.any(axis=1)
                rows.append(some[there]), bits.append(new[there])
        rows, bits = np.concatenate(rows), np.concatenate(bits)
        seen[rows] |= bits
        done[rows] = (seen[rows] == full).all(axis=1)
        return rows, bits

    def run(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the distances and of their inverses, from each of these vertices."""
        count, words = len(own), -(-len(own) // 64)
        far, near, member = np.zeros(count, np.int64), np.zeros(count), np.arange(count)  # member: a vertex's search
        front, seen = (np.zeros((self.n, words), np.uint64) for _ in range(2))
        done = np.zeros(self.n, bool)
        bit = np.arange(count)
        front[own, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        live, depth, touched = own, 0, [own]
        seen[own] = front[own]
        full = self._full(count)
        marks, series, closed = self._parities(live, seen[live]), [], set()
        while True:
            depth += 1
            rows, bits = self._step(live, front, seen, full, done)
            front[live] = 0
            front[rows] = bits
            live = rows
            if not len(rows):
                break
            touched.append(rows)
            if not series and len(full) > 1 and 16 * len(full) * sum(map(len, touched)) > HELD:
                return tuple(np.concatenate(x) for x in zip(*[self.run(some) for some in np.array_split(own, 8)], strict=True))
            new = np.zeros(64 * front.shape[1], np.int64)
            for at in range(0, len(rows), 1024):
                new += np.unpackbits(bits[at : at + 1024].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            told = np.flatnonzero(member >= 0)
            far[told] += depth * new[member[told]]
            near[told] += new[member[told]] / depth
            for k, s in enumerate(series):
                if k not in closed:
                    s.append(int(new[k]))
            stand = self._parities(rows, bits)
            marks = marks ^ stand
            _, which, group = np.unique(np.column_stack([marks, stand]), axis=0, return_index=True, return_inverse=True)
            group, left = group.ravel(), []
            own_group = group[member[told]]
            for g in np.unique(own_group):
                c, mine = int(which[g]), told[own_group == g]
                key = marks[c].tobytes() + stand[c].tobytes()
                series_known, at = self.known.get(key, (None, 0)) if new[c] else ([], 0)
                if series_known is None or any(series_known is s for k, s in enumerate(series) if k not in closed):
                    left.append((c, key, mine))
                    continue
                finds = np.array(series_known[at:], np.int64)
                distance = depth + 1 + np.arange(len(finds))
                far[mine] += int((finds * distance).sum())
                near[mine] += (finds / distance).sum()
                member[mine] = -1
                for k in np.flatnonzero(group[: len(series)] == g).tolist():
                    if k not in closed:
                        series[k] += finds.tolist()
                        closed.add(k)
            if not left:
                break
            if series:
                for c, key, _ in left:
                    self.known.setdefault(key, (series[c], len(series[c])))
            elif len(left) <= max(FEW_SEARCHES, 32 * front.shape[1] * (front.shape[1] > 1)):
                place, wide = np.unique(np.concatenate(touched)), -(-len(left) // 64)
                kept = [np.zeros((self.n, wide), np.uint64) for _ in range(2)]
                for k, (c, _, mine) in enumerate(left):
                    for of, to, some in ((seen, kept[0], place), (front, kept[1], live)):
                        to[some, k // 64] |= (of[some, c // 64] >> np.uint64(c % 64) & np.uint64(1)) << np.uint64(k % 64)
                    member[mine] = k
                marks = np.append(marks[[c for c, _, _ in left]], np.zeros(64 * wide - len(left), np.uint64))
                (seen, front), full, touched = kept, self._full(len(left)), [place]
                done[place] = (seen[place] == full).all(axis=1)
                live = live[front[live].any(axis=1)]
                if len(left) <= FEW_SEARCHES:
                    series = [[] for _ in left]
                    for s, (_, key, _) in zip(series, left, strict=True):
                        self.known.setdefault(key, (s, 0))
        return far, near

    @staticmethod
    def _full(count: int) -> np.ndarray:
        out = np.zeros(-(-count // 64), np.uint64)
        for k in range(len(out)):
            out[k] = np.uint64((1 << min(64, count - 64 * k)) - 1)
        return out


def closenesses(edges: DataFrame) -> DataFrame:
    """(id, closeness, harmonic) as centralities() has them, and as exact, without what betweenness needs: by searches from up
    to 4096 vertices at once, which go on as one where they have become the same (_Reach). Each task reads the adjacency (4
    bytes an edge end) from the shared folder; there is no largest graph."""
    scratch = Scratch(edges.sparkSession)
    u = scratch.write(edges.select("source", "target").where("source <> target"), "central-edges")
    ids = _numbered(u.select(F.explode(F.array("source", "target")).alias("id")).distinct(), scratch)
    adjacent = scratch.write(_adjacent(u, ids), "adjacency")
    n, spark = ids.count(), u.sparkSession
    cores = spark.sparkContext.defaultParallelism
    lot = int(np.clip(-(-n // (2 * cores)), 1, 4096))
    lots = -(-n // lot)
    tasks = max(1, min(lots, cores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        degrees, ends, task = {}, {}, None
        for batch in batches:
            for r in range(batch.num_rows):
                task, first = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                degrees[first], ends[first] = (np.frombuffer(batch.column(c)[r].as_py(), np.int32) for c in (2, 3))
        if task is None:
            return
        starts = np.append(0, np.cumsum(np.concatenate([degrees[x] for x in sorted(degrees)]), dtype=np.int64))
        targets = np.empty(starts[-1], np.int32)
        for first in sorted(ends):
            part = ends.pop(first)
            targets[starts[first] : starts[first] + len(part)] = part
        reach = _Reach(starts, targets)
        del starts, targets
        for at in range(lots * task // tasks * lot, min(n, lots * (task + 1) // tasks * lot), lot):
            own = np.arange(at, min(n, at + lot))
            far, near = reach.run(own)
            yield pa.RecordBatch.from_arrays([pa.array(reach.order[own]), pa.array(far), pa.array(near)], names=["n", "far", "near"])

    every = spark.range(0, tasks, 1, tasks).hint("shuffle_replicate_nl").crossJoin(adjacent.coalesce(1))
    told = ids.select("id", "n").join(every.mapInArrow(run, "n long, far long, near double"), "n")
    return scratch.result(told.select("id", F.coalesce(F.try_divide(F.lit(1.0), F.col("far").cast("double")), F.lit(0.0)).alias("closeness"), F.col("near").alias("harmonic")), "closeness")


def sketched_closeness(edges: DataFrame, log_size: int = 12) -> DataFrame:
    """(id, closeness, harmonic) of every vertex of an undirected graph of any size, estimated: each vertex has a counting
    sketch of the ball around it, which a round unites with those of its neighbours (one join and one sum) until no ball
    grows; what a round adds is at its distance. A count is off by about 1.04 / sqrt(2 ** log_size) in two of three cases;
    balls of a few hundred vertices are counted exactly."""
    scratch = Scratch(edges.sparkSession)
    u = scratch.write(undirected(edges), "ball-edges")
    none = F.lit(0.0)
    ids = u.select(F.col("source").alias("id")).distinct()
    balls = ids.groupBy("id").agg(F.hll_sketch_agg(F.col("id"), F.lit(log_size)).alias("ball")).select("id", "ball", F.lit(1.0).alias("size"), none.alias("far"), none.alias("near"), F.lit(True).alias("grew"))
    state, distance = scratch.write(balls, "balls"), 0
    while not state.where("grew").isEmpty():
        distance += 1
        told = u.join(state.where("grew").select(F.col("id").alias("target"), "ball"), "target").select(F.col("source").alias("id"), "ball", *[F.lit(None).cast("double").alias(c) for c in ("size", "far", "near")])
        united = told.unionByName(state.drop("grew")).groupBy("id").agg(F.hll_union_agg("ball").alias("ball"), *[F.max(c).alias(c) for c in ("size", "far", "near")])
        more = F.greatest(F.hll_sketch_estimate("ball").cast("double") - F.col("size"), none)
        grown = united.select("id", "ball", (F.col("size") + more).alias("size"), (F.col("far") + distance * more).alias("far"), (F.col("near") + more / distance).alias("near"), (more > 0).alias("grew"))
        after = scratch.write(grown, "balls")
        scratch.drop(state)
        state = after
    return scratch.result(state.select("id", F.coalesce(F.try_divide(F.lit(1.0), F.col("far")), none).alias("closeness"), F.col("near").alias("harmonic")), "sketched-closeness")


def sampled_centralities(edges: DataFrame, pivots: int = PIVOTS, seed: int = 1) -> DataFrame:
    """centralities() of a graph of any size, estimated by searches from the first `pivots` vertices by a seeded hash, level by level for all of
    them at once: one join and one sum a level forward (shortest paths) and one backward (what depends on a vertex). No
    task holds the graph. With as many pivots as vertices it is exact."""
    scratch = Scratch(edges.sparkSession)
    u = scratch.write(undirected(edges), "central-edges")
    ids = u.select(F.col("source").alias("id")).distinct()
    n = ids.count()
    start = ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pivots)
    levels = [scratch.write(start.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths"), F.lit(0).alias("depth")), "central")]
    before = levels[0].select("s", "id")
    while not levels[-1].isEmpty():
        step = levels[-1].join(u.withColumnRenamed("source", "id"), "id").groupBy("s", F.col("target").alias("id")).agg(F.sum("paths").alias("paths"))
        # of an undirected graph, a neighbour is new, or in this level or in the one before
        levels.append(scratch.write(step.join(before, ["s", "id"], "left_anti").select("s", "id", "paths", F.lit(len(levels)).alias("depth")), "central"))
        before = levels[-1].select("s", "id").unionByName(levels[-2].select("s", "id"))
    lean, every = None, []
    for level in reversed(levels[:-1]):
        here = level.withColumn("lean", F.lit(0.0)) if lean is None else level.join(lean, ["s", "id"], "left").withColumn("lean", F.coalesce("lean", F.lit(0.0)))
        here = scratch.write(here.select("s", "id", "paths", "depth", "lean"), "central-back")
        every.append(here)
        if len(every) < len(levels) - 1:
            up = levels[len(levels) - 2 - len(every)].select("s", F.col("id").alias("above"), F.col("paths").alias("p"))
            given = here.join(u.select(F.col("source").alias("id"), F.col("target").alias("above")), "id").join(up, ["s", "above"])
            lean = given.groupBy("s", F.col("above").alias("id")).agg(F.sum(F.col("p") / F.col("paths") * (1 + F.col("lean"))).alias("lean"))
    share = n / max(1, min(n, pivots))
    rows = reduce(DataFrame.union, every).groupBy("id").agg(F.sum(F.when(F.col("id") != F.col("s"), F.col("lean")).otherwise(0.0)).alias("b"), F.sum("depth").alias("far"), F.sum(F.when(F.col("depth") > 0, 1 / F.col("depth")).otherwise(0.0)).alias("h"))
    out = ids.join(rows, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * share / 2).alias("betweenness"), F.coalesce(F.try_divide(F.lit(1.0), F.col("far") * share), F.lit(0.0)).alias("closeness"), (F.coalesce("h", F.lit(0.0)) * share).alias("harmonic"))
    return scratch.result(out, "centralities")


def _first_to_act(pairs: DataFrame, scratch: Scratch, small: int) -> DataFrame:
    """(id) of the vertices that act when all are taken in order of id, and one acts unless a smaller neighbour did. A round
    lets all act that have no smaller undecided neighbour, and decides their neighbours; what is left once at most `small`
    pairs are undecided is walked through in one task (pairs of a chain in order of id decide one another one by one)."""
    kind = dict(pairs.dtypes)["a"]
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    open_, edges, acted = scratch.write(ends, "undecided"), pairs, []
    while edges.count() > small:
        act = scratch.write(open_.join(edges.select(F.col("b").alias("id")), "id", "left_anti"), "acting")
        out = act.union(edges.join(act.withColumnRenamed("id", "a"), "a").select("b")).distinct()
        out = scratch.write(out, "decided")
        after = scratch.write(open_.join(out, "id", "left_anti"), "undecided")
        left = edges.join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        left = scratch.write(left, "undecided-pairs")
        scratch.drop(open_, edges, out) if acted else scratch.drop(open_, out)
        open_, edges = after, left
        acted.append(act)

    def in_order(table: pa.Table) -> pa.Table:
        smaller: dict = {}
        for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            smaller.setdefault(b, []).append(a)
            smaller.setdefault(a, [])
        act: set = set()
        for v in sorted(smaller):
            if act.isdisjoint(smaller[v]):
                act.add(v)
        return pa.table({"id": pa.array(sorted(act), table["a"].type)})

    rest = edges.groupBy(F.lit("").alias("every")).applyInArrow(in_order, f"id {kind}")
    alone = open_.join(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))), "id", "left_anti")
    return scratch.write(reduce(DataFrame.union, [*acted, alone, rest]), "acting")


def structural_clusters(vertices: DataFrame, edges: DataFrame, ratio: float = 0.3, at_least: int = 3, small: int = SMALL) -> DataFrame:
    """(cluster, id): vertices in order of id; one not yet in a cluster takes in its unclustered neighbours whose
    common-neighbour ratio with it is above `ratio`; small clusters are dropped. A vertex that was taken was so by the
    smallest neighbour that acted, so who acts is found first, in rounds of joins (_first_to_act())."""
    scratch = Scratch(edges.sparkSession)
    pairs = scratch.write(common_ratio(edges).where(F.col("ratio") > ratio).select("a", "b"), "cluster-links")
    act = _first_to_act(pairs, scratch, small)
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    taken = both.join(act.withColumnRenamed("id", "a"), "a").join(act.withColumnRenamed("id", "b"), "b", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("cluster"))
    members = scratch.write(taken.select("cluster", "id").union(act.select(F.col("id").alias("cluster"), "id")), "members")
    large = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).select("cluster")
    return scratch.result(members.join(large, "cluster").select("cluster", "id"), "clusters")


def metadata(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by kind and type."""
    a = vertices.groupBy(F.col("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertex").alias("kind"), "type", "n")
    return a.union(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def first_match(links: DataFrame, targets: DataFrame, on: str, first: str) -> DataFrame:
    """links joined with the first target of each name; unmatched links are dropped."""
    named = targets.groupBy(on).agg(F.min(first).alias(first))
    return links.join(named, on)


