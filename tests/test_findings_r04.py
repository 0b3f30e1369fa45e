"""What the fourth round's findings named: each was cut, ended in an error, or grew too fast in a way that these hold against."""

import random

import numpy as np
import pytest

from marginalia.operators import graphs, neighbour_graph, vectors, walks
from marginalia.plans import retrieval as plans


def test_semantic_search_compares_all_chunks_however_many(spark, monkeypatch):
    want = sorted(map(tuple, plans.semantic_search(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(neighbour_graph, "build", lambda *a, **k: pytest.fail("a graph was built"))
    monkeypatch.setattr(plans, "COMPARED", 64)
    assert sorted(map(tuple, plans.semantic_search(spark, "/root/testdata/sf0.001").collect())) == want and len(want) == 10


def _shuffled(spark):
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_a_step_of_a_walk_sends_no_edges(spark, monkeypatch):
    monkeypatch.setattr(graphs, "PART", 1000, raising=False)
    pick = random.Random(6)
    n, sent, got = 5000, [], []
    rows = [(i, j, pick.random()) for i in range(n) for j in {pick.randrange(n) for _ in range(6)} if i != j]
    edges = spark.createDataFrame(rows, "source long, target long, weight double").repartition(4).localCheckpoint()
    seeds = spark.createDataFrame([(0, 0.75), (7, 0.25), (n + 1, 0.5)], "id long, score double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for steps in (8, 12):
        before = _shuffled(spark)
        got.append({r.id: r.score for r in graphs.walk(seeds, edges, steps).collect()})
        sent.append(_shuffled(spark) - before)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sent[1] - sent[0] < 4 * 20 * n, sent
    total, out = {}, {}
    for a, b, w in rows:
        total[a] = total.get(a, 0) + w
        out.setdefault(a, []).append((b, w))
    start = {0: 0.75, 7: 0.25, n + 1: 0.5}
    p, spent = dict(start), dict(start)
    for _ in range(11):
        after = {k: 0.15 * s for k, s in start.items()}
        after[n + 1] += 0.85 * p[n + 1]
        for k, s in p.items():
            for t, w in out.get(k, []):
                after[t] = after.get(t, 0) + 0.85 * s * w / total[k]
        p = after
        spent = {k: spent.get(k, 0) + p.get(k, 0) for k in spent | p}
    assert got[1] == {k: pytest.approx(s / 12, abs=1e-12) for k, s in spent.items()}


def test_a_walk_over_similar_vectors_passes_few_times_over_edges_kept(spark, monkeypatch):
    v = np.random.default_rng(8).normal(size=(400, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    s = v @ v.T
    s[s <= 0.45] = 0
    np.fill_diagonal(s, 0)
    total, start = s.sum(axis=1), np.zeros(len(v))
    start[[3, 9, 77]] = 0.75, 0.5, 0.25
    p, spent = start, start
    for _ in range(99):
        p = 0.85 * (s @ np.divide(p, total, out=np.zeros(len(v)), where=total > 0) + np.where(total == 0, p, 0)) + 0.15 * start
        spent = spent + p
    calls, plain = [], walks.sums
    monkeypatch.setattr(walks, "sums", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(vectors, "TOLD", 100)  # several rows of edges for two blocks
    seeds = spark.createDataFrame([(3, 0.75), (9, 0.5), (77, 0.25)], "id long, score double")
    got = {r.id: r.score for r in vectors.similarity_walk(df, seeds, 0.45, block=64).collect()}
    assert got == {int(i): pytest.approx(spent[i] / 100, abs=1e-12) for i in np.flatnonzero(spent)}
    assert len(got) > 300 and len(calls) < 60


@pytest.mark.parametrize("fewest", [1, 6, 1000])
def test_neighbours_laid_out_give_the_sums_of_all_edges(monkeypatch, fewest):
    for name, value in (("PIECE", 3), ("LAID", 7), ("FEWEST", fewest), ("SUMMED", 200)):
        monkeypatch.setattr(graphs, name, value)
    pick = random.Random(fewest)
    pairs = {(pick.randrange(60), pick.randrange(60)) for _ in range(150)} | {(0, i) for i in range(1, 50)} | {(62, 63)}
    ends = sorted({e for a, b in pairs if a != b for e in ((a, b), (b, a))})
    starts = np.append(0, np.cumsum(np.bincount([a for a, _ in ends], minlength=64))).astype(np.int64)
    searches = graphs._Searches(starts, np.array([b for _, b in ends], np.int32))
    assert len(searches.pieces) + len(searches.rest) > 0 and (fewest < 1000) == bool(searches.pieces) and (fewest > 1) == bool(len(searches.rest))
    near = np.zeros((64, 64))
    near[tuple(np.array(ends).T)] = 1
    given, every = np.random.default_rng(1).random((64, 5)), np.ones(64, bool)
    assert np.allclose(searches._sums(given, every, every), near @ given)
    few = np.arange(64) == 62
    assert np.allclose(searches._sums(given * few[:, None], few, every)[63], given[62])


def test_exact_closeness_has_no_largest_graph(spark, monkeypatch):
    pick = random.Random(14)
    rows = [(f"v{pick.randrange(90)}", f"v{pick.randrange(90)}") for _ in range(140)] + [("x", "y"), ("z", "z")]
    df = spark.createDataFrame(rows, "source string, target string")
    want = {r.id: (pytest.approx(r.closeness), pytest.approx(r.harmonic)) for r in graphs.centralities(df).collect()}
    monkeypatch.setattr(graphs, "MOST_ENDS", 7)
    monkeypatch.setattr(graphs, "PART", 20)
    assert {r.id: (r.closeness, r.harmonic) for r in graphs.closenesses(df).collect()} == want and len(want) > 80


@pytest.mark.parametrize("few, held", [(1, 10**9), (64, 10**9), (64, 4000)])
def test_searches_that_have_become_the_same_go_on_as_one(monkeypatch, few, held):
    monkeypatch.setattr(graphs, "FEW_SEARCHES", few)
    monkeypatch.setattr(graphs, "HELD", held)
    pick = random.Random(few)
    ring = [(c * 30 + a, c * 30 + b) for c in range(10) for a in range(30) for b in range(a) if pick.random() < 0.2 or a == b + 1]
    ring += [(c * 30 + 29, (c * 30 + 30) % 300) for c in range(10)]  # dense parts, led from one to the next
    other = [(300 + pick.randrange(80), 300 + pick.randrange(80)) for _ in range(60)] + [(400, 401 + i) for i in range(70)] + [(500 + i, 501 + i) for i in range(90)]
    pairs = {(a, b) for a, b in ring + other if a != b}
    names = sorted({v for e in pairs for v in e})
    at = {v: i for i, v in enumerate(names)}
    ends = sorted({(at[x], at[y]) for a, b in pairs for x, y in ((a, b), (b, a))})
    starts = np.append(0, np.cumsum(np.bincount([a for a, _ in ends]))).astype(np.int64)
    targets = np.array([b for _, b in ends], np.int32)
    reach, n = graphs._Reach(starts, targets), len(names)
    far, near = np.zeros(n, int), np.zeros(n)
    for x in range(0, n, 200):
        own = np.arange(x, min(n, x + 200))
        far[reach.order[own]], near[reach.order[own]] = reach.run(own)
    for v in range(n):
        depth, queue = {v: 0}, [v]
        for x in queue:
            for y in targets[starts[x] : starts[x + 1]].tolist():
                if y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
        assert far[v] == sum(depth.values()) and near[v] == pytest.approx(sum(1 / d for d in depth.values() if d))
    assert few == 1 or held < 10**9 or reach.known
