"""Operators without SQL, and what a query alone doesn't show: against plain versions and small tables."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import plans
from marginalia.functions import forms
from marginalia.operators import commands, graphs, retrieval, texts, vectors
from marginalia.operators import model as M
from marginalia.streaming import events

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = plans.collected()


def test_sampled_centralities_from_all_vertices_are_exact(spark):
    pick = random.Random(6)
    e = [(f"v{pick.randrange(40)}", f"v{pick.randrange(40)}") for _ in range(70)] + [("x", "y"), ("y", "z")]
    df = spark.createDataFrame(e, "source string, target string")
    want = {r.id: r[1:] for r in graphs.centralities(df).collect()}
    got = {r.id: r[1:] for r in graphs.sampled_centralities(df, 10_000).collect()}
    assert set(want) == set(got) and all(x == pytest.approx(y, abs=1e-9) for k in want for x, y in zip(want[k], got[k], strict=True))
    some = {r.id: r.closeness for r in graphs.sampled_centralities(df, 5).collect()}
    assert set(some) == set(want)


def test_long_paths_are_followed_to_their_ends(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(130)], "source long, target long")
    found = graphs.shortest_paths(chain, 0)
    assert found.count() == 131 and found.agg(F.max("depth")).first()[0] == 130
    assert [r.id for r in graphs.path_nodes(found, 12).collect()] == list(range(13)) and graphs.path_nodes(found, 999).count() == 0


def test_graph_model_edge_cases(spark):
    notes = spark.createDataFrame([("1", "a", "<<b>> <<b>> <<a>> [[b]] #t #t", "f"), ("2", "b", "<<<a>> [[nowhere]]", None), ("3", "b", None, "f"), ("4", None, "<<b>>", None)], "id string, title string, content string, parent_id string")
    assert {(r.id, r.other) for r in M.backlinks(notes).collect()} == {("2", "1"), ("3", "1"), ("2", "4"), ("3", "4"), ("1", "2")}
    kg = spark.createDataFrame([], "id string, entities array<struct<id string, value string, type string, confidence double>>, triples array<struct<subject string, predicate string, object string, confidence double>>")
    e = M.edges(M.full_notes(notes, kg)).collect()
    assert {(r.source, r.target) for r in e if r.type == "links"} == {("1", "2")} and len([r for r in e if r.type == "mentions"]) == 1
    f = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")
    assert {r.id: r.parent_id for r in M.moved(f, ["a"], "c").collect()} == {"a": None, "b": "a", "c": "b"}
    assert {r.id: r.parent_id for r in M.moved(f, ["c"], None).collect()}["c"] is None


def test_report_and_communities_hold_the_whole_graph(spark):
    r = QUERIES["centrality_report"](spark, DIR).collect()
    assert len(r) == 20 and [x["rank"] for x in r] == sorted((x["rank"] for x in r), reverse=True)
    assert all(x.degree >= 1 and 0 < x.closeness < 1 and x.betweenness >= 0 for x in r)
    c = QUERIES["communities"](spark, DIR)
    assert {x.community for x in c.select("community").distinct().collect()} >= {"type-note", "type-folder", "type-tag"}


def test_chunks_of_every_kind(spark):
    got = {r.id: r for r in QUERIES["chunk_kinds"](spark, DIR).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for i, r in docs.items():
        whole = f"{r.source}-{i}\n\n{r.text}"
        parts = [p for p in (x.strip() for x in re.split("[.!?]", whole)) if p]
        assert got[i].sentences == len(parts) and got[i].basic == len(texts.packed(parts)) and got[i].semantic == len(texts.semantic(whole, 500, 0.7))
    with pytest.raises(ValueError):
        retrieval.cut("x", retrieval.Chunking("other"))


def test_search_against_plain(spark):
    """Seeds by cosine, expected walk, best chunks: recomputed with dictionaries."""
    rows = [(i, f"title {i}", f"{'apple pear' if i % 3 else 'stone river'} number {i} and {'more fruit' if i % 2 else 'cold water'}. ") for i in range(24)]
    notes = spark.createDataFrame(rows, "id long, title string, content string")
    p = retrieval.Providers()
    nodes = retrieval.nodes_of(notes, p.current()).cache()
    edges = retrieval.edges_of(nodes, 0.5, 6).cache()
    vec = {r.node: np.array(r.vec) for r in nodes.collect()}
    assert len(vec) == 24 and all(math.isclose(v @ v, 1) for v in vec.values())
    q = retrieval.hashed(["apple fruit"])[0]
    seeds = {k: v @ q for k, v in vec.items() if v @ q > 1e-9}  # fewer than twice 24
    out = {}
    for e in edges.collect():
        out.setdefault(e.source, []).append((e.target, e.weight))
    state, spent = dict(seeds), dict(seeds)
    for _ in range(11):
        after = {k: 0.15 * s for k, s in seeds.items()}
        for k, s in state.items():
            if k in out:
                total = sum(w for _, w in out[k])
                for t, w in out[k]:
                    after[t] = after.get(t, 0) + 0.85 * s * w / total
            elif k in seeds:
                after[k] += 0.85 * s
        state = after
        for k, s in state.items():
            spent[k] = spent.get(k, 0) + s
    want = sorted(spent.values(), reverse=True)[:24]
    got = sorted((r.score for r in retrieval.search(nodes, edges, "apple fruit", p.current(), 24, 12).collect()), reverse=True)
    assert got == pytest.approx([x / 12 for x in want], abs=1e-9)
    assert retrieval.search(nodes, edges, " \n ", p.current()).count() == 0
    assert retrieval.search(nodes, edges, "apple", retrieval.Provider(8, lambda t: np.ones((len(t), 8)))).count() == 0
    assert p.switch("hashing-asymmetric") is False and p.current().prefix.startswith("Represent")
    p.add("small", retrieval.Provider(8, lambda t: np.ones((len(t), 8))))
    assert p.switch("small") is True and p.dim == 8
    with pytest.raises(KeyError):
        p.switch("none")


def test_sync_embeds_only_what_is_new(spark):
    asked = spark.sparkContext.accumulator(0)

    def counted(batch):
        asked.add(len(batch))
        return retrieval.hashed(batch)

    p = retrieval.Provider(64, counted)
    notes = spark.createDataFrame([(i, f"t{i}", f"text {i}") for i in range(8)], "id long, title string, content string")
    nodes = retrieval.nodes_of(notes, p).collect()
    assert asked.value == 8
    have = spark.createDataFrame(nodes, "node string, note string, title string, chunk int, text string, vec array<double>")
    later = notes.where("id < 6").withColumn("content", F.when(F.col("id") == 2, "changed").otherwise(F.col("content")))
    after = retrieval.synced(have, later, p).collect()
    assert asked.value == 9 and {r.note for r in after} == {str(i) for i in range(6)}
    assert {r.note: r.vec for r in after if r.note != "2"} == {r.note: r.vec for r in nodes if int(r.note) < 6 and r.note != "2"}


def test_index_store_verifies(spark):
    store = retrieval.IndexStore(spark)
    rows = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "id long, token string, tf long")
    store.save("x", rows)
    assert sorted(store.load("x").collect()) == sorted(rows.collect()) and store.load("y") is None
    assert retrieval.digest(rows) == retrieval.digest(rows.orderBy(F.desc("id"))) != retrieval.digest(rows.limit(1))
    rows.limit(1).write.mode("overwrite").parquet(store.current().first()["path"])
    spark.catalog.clearCache()
    assert store.load("x") is None
    store.delete("x")
    assert store.load("x") is None and store.current().count() == 0


def test_snapshot_records(spark):
    nodes = spark.createDataFrame([(1, [0.5, -2.0], [[2, 3], []]), (-7, [1.0, 0.0], [])], "id long, vec array<double>, near array<array<long>>")
    assert sorted(retrieval.unpacked_nodes(retrieval.packed_nodes(nodes, 2)).collect()) == sorted(nodes.collect())
    with pytest.raises(Exception, match="dimensions"):
        retrieval.packed_nodes(nodes, 3).collect()
    with pytest.raises(Exception, match="not a snapshot"):
        retrieval.unpacked_nodes(spark.createDataFrame([(bytearray(30),)], "record binary")).collect()


def test_rule_entities_against_single_patterns():
    t = "On 2024-05-06 at 10:30 mail a.b@c.org, see https://x.org/a?b, pay $1,200.50 or 15% of the 3rd 1,000."
    got = texts.recognized(t)
    assert [(v, k) for v, k, *_ in got] == [("2024-05-06", "DATE"), ("10:30", "TIME"), ("a.b@c.org", "EMAIL"), ("https://x.org/a?b,", "URL"), ("$1,200.50", "MONEY"), ("15%", "PERCENT"), ("3rd", "ORDINAL"), ("1,000", "CARDINAL")]
    assert all(t[a:b] == v and re.fullmatch(texts.RULES[k], v, re.ASCII) and c == 0.9 for v, k, a, b, c in got)
    r = texts.Recognizers()
    r.add("none", lambda t: [])
    r.switch("none")
    assert r.active == "none" and texts.recognized(None) == [] and len(texts.LABELS) == 37


def test_plain_text_of_odd_documents():
    assert texts.plain("not json") is None and texts.plain(None) is None
    assert [texts.plain(x) for x in ("5", "[]", "{}", '{"content":7}', '{"content":[1,{"text":"a"}]}')] == ["", "", "", "", "a"]
    deep = '{"type":"paragraph","content":[' * 400 + '{"text":"x"}' + "]}" * 400
    assert texts.plain('{"content":[' + deep + "]}") == "x"


def test_provider_failures_are_empty_answers(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "id long, prompt string")

    def ask(prompts):
        if "p3" in prompts:
            raise TimeoutError
        return ["{}"] * (len(prompts) - 1)

    got = {r.id: r.json for r in commands.answered(df.coalesce(1), "id", "prompt", ask, 3).collect()}
    assert got == {0: "{}", 1: "{}", 2: "[]", 3: "[]", 4: "[]", 5: "[]", 6: "[]"}


def test_names_and_types(spark):
    assert forms.snake("someKeyName") == "some_key_name" and forms.camel("some_key_name") == "someKeyName"
    df = spark.createDataFrame([(1, (2, [(3,)]))], "aB int, cD struct<eF:int, gH:array<struct<iJ:int>>>")
    assert forms.renamed(df, aliases={"aB": "otherName"}).schema.simpleString() == "struct<other_name:int,c_d:struct<e_f:int,g_h:array<struct<i_j:int>>>>"
    raw = spark.createDataFrame([(x,) for x in ("[", "[]", None, "{oops", "{}", "5", "")], "raw string")
    assert [r[0] for r in raw.select(forms.attributes(F.col("raw"))).collect()] == [{}, {}, {}, {"text": "{oops"}, {}, {"text": "5"}, {"text": ""}]


def test_streams_tell_subscribers(spark):
    told, other = [], []
    changes = events.Changes(spark)
    stop = changes.subscribe(lambda kind, query, rows: told.append((kind, rows)))
    changes.subscribe(lambda *a: 1 / 0)
    changes.subscribe(lambda *a: other.append(a))
    try:
        events.run_to_end(events.files(spark, f"{DIR}/nation*.parquet").select("n_name"), "told", "append")
        import time

        for _ in range(50):
            if any(k == "ended" for k, _ in told):
                break
            time.sleep(0.1)
        assert ("progress", 25) in told and told[0][0] == "started" and len(other) == len(told)
        stop()
        changes._tell("progress", "x", 1)
        assert len(other) == len(told) + 1
    finally:
        spark.streams.removeListener(changes)


def test_neighbours_of_queries_and_ties(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(30)], "id long, vec array<double>")
    q = v.where("id in (3, 4)")
    got = sorted((r.source, r["rank"], r.target) for r in vectors.knn(v, 4, block=7, queries=q).collect())
    assert got == [(3, 1, 1), (3, 2, 3), (3, 3, 5), (3, 4, 7), (4, 1, 0), (4, 2, 2), (4, 3, 4), (4, 4, 6)]


def test_registry_holds_the_surveyed_defaults(spark):
    from marginalia.operators import sync

    rows = {(r.kind, r.name): (r.type, r.fallback, r.unit) for r in sync.registry(spark).collect()}
    # Fixed values, written out here apart from the registry.
    assert rows["NPC", "faction"] == ("EntityLink", '{"id":"","label":"","kind":"FACTION"}', "")
    assert rows["ITEM", "owner"] == ("EntityLink", '{"id":"","label":"","kind":"CHARACTER"}', "")
    assert rows["SCENE", "duration"] == ("Number", "30", "minutes") and rows["ITEM", "value"] == ("Number", "0", "gold")
    assert rows["CHARACTER", "mana"] == ("ProgressBar", '{"current":50,"maximum":50}', "") and rows["EVENT", "date"][0] == "Date"
    assert rows["ITEM", "magical"] == ("Boolean", "false", "") and rows["LOCATION", "size"] == ("Text", "Medium", "")
    assert len(rows) == 70 and {k for k, _ in rows} == {"CHARACTER", "NPC", "LOCATION", "SCENE", "ITEM", "FACTION", "EVENT"}


def test_words_that_cancel_out_still_have_a_vector():
    from itertools import combinations

    made = {w: retrieval.hashed([w])[0] for w in (f"w{i}" for i in range(300))}
    a, b = next((a, b) for a, b in combinations(made, 2) if not (made[a] + made[b]).any())
    both, none, other = retrieval.hashed([f"{a} {b}", "  ", "x"])
    assert (both**2).sum() == 1 and not none.any() and (other == retrieval.hashed(["x"])[0]).all()


def _vectors_of(spark, n, dim=6, seed=3):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(n + i, [float(x) for x in v[i]]) for i in range(5)], "id long, vec array<double>")


def test_pairs_of_blocks_meet_without_a_shuffle(spark):
    df = _vectors_of(spark, 40)
    plan = vectors.similar_pairs(df, 0.3, block=7)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    rows = vectors.knn(df, 4, block=7).collect()
    assert len(rows) == 180 and [(r.target, r.score) for r in rows if r.source == 40 and r["rank"] < 3] == [(0, 1.0), (40, 1.0)]


def test_codes_meet_in_parts_and_give_the_same(spark):
    df = _vectors_of(spark, 60)
    one, some = (sorted(tuple(r) for r in vectors.lsh_knn(df, df.where("id % 4 = 0"), 5, 6, bits=3, tables=6, block=b).collect()) for b in (4096, 3))
    assert one == some and len(one) == 17 * 5 and all(r[0] == r[1] or r[2] < 1.0001 for r in one)


@pytest.mark.parametrize("steps, least", [(1, 0.75), (2, 0.75), (5, 0.75), (100, 0.0)])
def test_walk_over_similar_vectors_is_the_walk_over_their_edges(spark, steps, least):
    df = _vectors_of(spark, 40).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0 if least else 9.0)))
    seeds = spark.createDataFrame([(0, 0.75), (7, 0.5), (39, -0.25), (999, 0.5)], "id long, score double")
    v = np.array([r.vec for r in df.orderBy("id").collect()])
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = v @ v.T
    s[s <= least] = 0
    np.fill_diagonal(s, 0)
    total, start = s.sum(axis=1), np.zeros(len(v))
    start[[0, 7, 39]] = 0.75, 0.5, -0.25
    p, met, spent = start, start != 0, start
    for _ in range(steps - 1):
        p = 0.85 * (s.T @ np.divide(p, total, out=np.zeros(len(v)), where=total > 0) + np.where(total == 0, p, 0)) + 0.15 * start
        met, spent = met | (s.T @ met > 0), spent + p
    want = {int(i): pytest.approx(spent[i] / steps, abs=1e-11) for i in np.flatnonzero(met)} | {999: 0.5}
    assert {r.id: r.score for r in vectors.similarity_walk(df, seeds, least, steps, block=9).collect()} == want and len(want) > 3


def test_searches_start_once_for_vertices_with_the_same_neighbours(spark, monkeypatch):
    pick = random.Random(11)
    e = {(a, 100 + b) for a in range(6) for b in (0, 1, 2)} | {(200 + i, 100) for i in range(30)} | {(100, 101), (300, 301)}
    e |= {tuple(sorted((400 + pick.randrange(12), 400 + pick.randrange(12)))) for _ in range(25)} | {(400, 102)}
    df = spark.createDataFrame(sorted(e), "source long, target long")
    n = df.select("source").union(df.select("target")).distinct().count()
    got = {r.id: r[1:] for r in graphs.centralities(df).collect()}
    want = {r.id: r[1:] for r in graphs.sampled_centralities(df, n).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    star = graphs._Searches(np.append([0, 50], np.arange(51, 101)), np.append(np.arange(1, 51), np.zeros(50, np.int64)).astype(np.int32))
    assert sorted(map(len, star.alike())) == [1, 50]


def test_closeness_by_bits_is_that_of_searches(spark, monkeypatch):
    monkeypatch.setattr(graphs, "SEEN", 1)
    monkeypatch.setattr(graphs, "GATHERED", 80)
    pick = random.Random(12)
    e = [(f"v{pick.randrange(150)}", f"v{pick.randrange(150)}") for _ in range(170)] + [("x", "y"), ("y", "z"), ("w", "w")]
    df = spark.createDataFrame(e, "source string, target string")
    want = {r.id: (pytest.approx(r.closeness), pytest.approx(r.harmonic)) for r in graphs.centralities(df).collect()}
    assert {r.id: (r.closeness, r.harmonic) for r in graphs.closenesses(df).collect()} == want
    assert graphs.closenesses(df.limit(0)).count() == 0
