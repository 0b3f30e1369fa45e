import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.operators import graphs, lexical, texts, trees, vectors
from marginalia.sources import snapshots


@settings(max_examples=400, deadline=None)
@given(st.text("abc \n", max_size=40), st.text("abc \n", max_size=40))
def test_delta_round_trip(a, b):
    assert texts.applied(a, texts.delta(a, b)) == b


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n", max_size=300))
def test_windows_are_pieces_of_the_text(text):
    found = texts.windows(text, 40, 5)
    clean = text.strip()
    assert all(clean[a:b].strip() == t and t for _, a, b, t in found)
    assert all(x[2] <= y[1] for x, y in zip(found, found[1:], strict=False))
    assert bool(found) == bool(clean)


def test_chunks():
    parts = texts.sentences("One two. Three! Four? ...")
    assert parts == ["One two", "Three", "Four"]
    assert texts.packed(["a" * 40] * 5, 25) == ["a" * 40 + " " + "a" * 40] * 2 + ["a" * 40]
    assert texts.semantic("") == [] and len(texts.semantic("a b c. a b c. a b c.")) == 1
    tree = '{"type":"doc","content":[{"type":"text","text":"hi","marks":[{"type":"tag","attrs":{"label":"t"}}]},{"type":"wikilink","attrs":{"target":"W"}},{"type":"triple","attrs":{"p":1}}]}'
    assert texts.walked(tree)["tags"] == ["t"] and texts.walked(tree)["links"] == ["W"] and texts.walked("{oops")["text"] == []


def test_snapshot_round_trip():
    nodes = [(7, [0.5, -1.0], [[1, 2], []]), (8, [0.0, 3.0], [])]
    data = snapshots.encode(nodes, 2)
    assert snapshots.decode(data) == (2, nodes) and snapshots.verified(data, "x") is None
    with pytest.raises(ValueError):
        snapshots.decode(b"\0" * 12)


def test_fusion_and_guards(spark):
    s = spark.createDataFrame([(1, 4.0), (2, 2.0)], "id long, score double")
    d = spark.createDataFrame([(2, 0.5), (2, 1.0), (3, 0.5)], "id long, score double")
    assert [(r.id, round(r.score, 6)) for r in lexical.fuse(s, d, 0.5).collect()] == [(2, 0.75), (1, 0.5), (3, 0.25)]
    with pytest.raises(ValueError):
        lexical.fuse(s, d, 1.5)
    docs = spark.createDataFrame([(1, "the cat"), (2, "other"), (3, None)], "id long, doc string")
    assert {r.id for r in lexical.top(lexical.bm25(docs, "the"), 5, positive=True).collect()} == {1, 2}
    assert lexical.bm25(docs, " ").count() == 0


def test_trees_with_a_cycle(spark):
    f = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "x")], "id string, parent_id string")
    assert {r.id for r in trees.descendants(f, "id = 'a'").collect()} == {"a", "b", "c", "d"}


def test_neighbours_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-(u @ u.T)[i])[:5]}
    assert {(r.source, r.target) for r in vectors.knn(df, 5, block=17).collect()} == want
    pairs = {(r.source, r.target) for r in vectors.similar_pairs(df, 0.4, block=17).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if (u @ u.T)[i, j] > 0.4}


def test_graph_measures(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 5)], "source long, target long")
    c = {r.id: r for r in graphs.centralities(star).collect()}
    assert c[0].betweenness == 6 and c[1].betweenness == 0 and math.isclose(c[1].closeness, 1 / 7) and math.isclose(c[0].harmonic, 4)
    path = {r.id: r.depth for r in graphs.shortest_paths(star, 1).collect()}
    assert path == {1: 0, 0: 1, 2: 2, 3: 2, 4: 2}


def test_sketched_closeness_of_every_vertex(spark):
    pick = random.Random(9)
    rows = [(i, pick.randrange(i)) for i in range(1, 900)] + [(2000, 2001), (3000, 3000)]
    df = spark.createDataFrame(rows, "source long, target long")
    want = {r.id: r for r in graphs.centralities(df).collect()}
    got = {r.id: r for r in graphs.sketched_closeness(df).collect()}
    assert set(got) == set(want)
    off = sorted(abs(got[i].closeness / want[i].closeness - 1) for i in want)
    assert off[-1] < 0.08 and off[len(off) // 2] < 0.03
    assert max(abs(got[i].harmonic / want[i].harmonic - 1) for i in want) < 0.08
    assert got[2000].closeness == 1 and graphs.sketched_closeness(df.limit(0)).count() == 0


def test_large_graphs_are_not_estimated_unasked(spark, monkeypatch):
    monkeypatch.setattr(graphs, "MOST_ENDS", 7)
    star = spark.createDataFrame([(0, i) for i in range(1, 5)], "source long, target long")
    with pytest.raises(ValueError, match="sampled_centralities"):
        graphs.centralities(star)
    assert graphs.centralities(star.limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 3, 100_000])
def test_clusters_against_a_walk_in_order(spark, small):
    pick = random.Random(small)
    rows = [(f"a{i:02d}", f"a{j:02d}") for i in range(14) for j in range(i) if pick.random() < 0.45]
    rows += [(f"b{i:02d}", f"b{i + d:02d}") for i in range(16) for d in (1, 2)] + [("z", "z"), ("a00", "b00")]
    near = {}
    for a, b in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    ratios = {(a, b): len(near[a] & near[b]) / max(len(near[a]), len(near[b])) for a in near for b in near[a] if a < b}
    df = spark.createDataFrame(rows, "source string, target string")
    assert {(r.a, r.b): round(r.ratio, 12) for r in graphs.common_ratio(df).collect()} == {k: round(x, 12) for k, x in ratios.items()}
    passing = {}
    for (a, b), x in ratios.items():
        if x > 0.2:
            passing.setdefault(a, set()).add(b)
            passing.setdefault(b, set()).add(a)
    done, want = set(), set()
    for v in sorted(passing):
        if v not in done:
            group = {v} | (passing[v] - done)
            done |= group
            want |= {(v, x) for x in group} if len(group) >= 3 else set()
    got = graphs.structural_clusters(df.select(df.source.alias("id")), df, 0.2, small=small).collect()
    assert {(r.cluster, r.id) for r in got} == want and len(got) == len(want) > 10


def test_rank_plans_do_not_grow(spark):
    e = spark.createDataFrame([(i, (i * 7 + 1) % 20) for i in range(19)], "source long, target long")
    v = spark.range(20)
    scans = {n: graphs.pagerank(v, e, 0.85, n)._jdf.queryExecution().optimizedPlan().toString().count("Relation") for n in (1, 4)}
    assert scans[1] == scans[4] == 1


def test_walk_keeps_its_mass(spark):
    pick = random.Random(2)
    e = [(pick.randrange(12), pick.randrange(12), pick.random()) for _ in range(30)]
    e = [x for x in e if x[0] != x[1]]
    edges = spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "source long, target long, weight double")
    seeds = spark.createDataFrame([(e[0][0], 0.75), (99, 0.25)], "id long, score double")
    r = {x.id: x.score for x in graphs.walk(seeds, edges, 6).collect()}
    assert math.isclose(sum(r.values()), 1) and math.isclose(r[99], 0.25)


def test_histories_against_one_list(spark):
    from pyspark.sql import functions as F

    from marginalia.operators import sync

    pick = random.Random(4)
    rows = [(pick.randrange(5), i, pick.choice(["do", "do", "undo", "redo"])) for i in range(400)]
    want = {}
    for k in range(5):
        done, undone = [], []
        for _, s, a in [r for r in rows if r[0] == k]:
            if a == "do":
                done, undone = (done + [s])[-7:], []
            elif a == "undo" and done:
                undone = undone + [done[-1]]
                done = done[:-1]
            elif a == "redo" and undone:
                done = done + [undone[-1]]
                undone = undone[:-1]
        want[k] = (len(done), len(undone), done[-1] if done else None)
    df = spark.createDataFrame(rows, "k long, s long, a string")
    assert {r.k: (r.undo, r.redo, r.last) for r in sync.histories(df, "k", "s", F.col("a"), 7).collect()} == want
