import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import near_duplicates as nd
from marginalia.llm.components import components
from marginalia.llm.near_duplicates import near_duplicates, prefix_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k=5, percent=80):
    sets = []
    for d, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    part = {d: d for d, _ in sets if d is not None}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                n = len(s & t)
                if 100 * n >= percent * (len(s) + len(t) - n):
                    x, y = sorted((root(a), root(b)))
                    part[y] = x
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=str)


def rows(df):
    return sorted(((r[0], r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = rows(near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), bucket_bytes=200_000))
    assert got == brute(docs)
    assert any(d != c for d, _, c in got)


def test_groups_chains_and_edges(spark):
    pick = random.Random(3)
    docs, n = [], 0
    for _ in range(12):  # chains of small edits around a text: links that are not transitive
        w = [pick.choice("abcdefghij") for _ in range(pick.randrange(3, 60))]
        for _ in range(20):
            docs.append((n, " ".join(w)))
            n += 1
            w = list(w)
            w[pick.randrange(len(w))] = pick.choice("ABCDEFGHIJ")
    docs += [(None, docs[0][1]), (None, None), (500, None), (501, ""), (502, " \n"), (503, docs[40][1].upper()), (503, docs[40][1]), (504, "one two"), (505, "one two"), (506, "one two three"), (507, "z " * 40_000)]
    docs += [(600 + i, docs[100][1]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(near_duplicates(df)) == brute(docs)
    assert rows(near_duplicates(df, percent=50).select("doc_id", "n_shingles", "component_id")) == brute(docs, percent=50)
    assert near_duplicates(df.limit(0)).count() == 0
    odd = df.withColumnsRenamed({"doc_id": "n_shingles", "text": "digest"}).limit(30)
    assert near_duplicates(odd, id_col="n_shingles", text_col="digest").count() == 30


def thue_morse(a, b, n):
    x, y = [a], [b]
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_different_words_stay_different(spark):
    """Words and sequences that sums of powers confuse, and words that agree in the first 40 bits of such hashes."""
    x, y = thue_morse("a", "b", 4096)
    docs = [(1, "".join(x)), (2, "".join(y)), (3, " ".join(x)), (4, " ".join(y)), (5, "k1d0df4"), (6, "k2137fc"), (7, "".join(x) + " t u v w"), (8, "".join(y) + " t u v w")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(near_duplicates(df))
    assert got == brute(docs)
    assert [c for d, _, c in got if d in (1, 2, 5, 6, 7, 8)] == [1, 2, 5, 6, 7, 8]


def test_no_pair_is_verified_below_its_count(spark, monkeypatch):
    """What comes to verification, from chains and from posting lists, shares min(l, l') elements of its prefixes."""
    pick = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        w = list(base[: pick.randrange(30, 120)])
        for _ in range(pick.randrange(6)):
            w[pick.randrange(len(w))] = f"x{pick.randrange(9)}"
        docs.append((i, " ".join(w)))
    seen, counted = [], nd._counted

    def noted(pairs, classes, percent):
        out = counted(pairs, classes, percent)
        known = {r.rep: r for r in classes.collect()}
        for r in out.select("a", "b", "met").collect():
            a, b = known[r.a], known[r.b]
            met = len(set(a.tokens[: a["take"]]) & set(b.tokens[: b["take"]]))
            seen.append((met == r.met, met, min(a.l, b.l)))
        return out

    monkeypatch.setattr(nd, "_counted", noted)
    assert rows(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert seen and all(same and met >= least for same, met, least in seen) and any(least > 1 for _, _, least in seen)


def test_meetings_are_counted_over_all_lists(spark):
    pick = random.Random(9)
    sets = {i: sorted(pick.sample(range(1, 40), 12)) for i in range(60)}
    df = {x: sum(x in s for s in sets.values()) for x in range(40)}
    lines = [(r, 12, sorted(s, key=lambda x: (df[x], x)), [df[x] for x in sorted(s, key=lambda x: (df[x], x))]) for r, s in sets.items()]
    classes = spark.createDataFrame([(*line, *prefix_of(12, np.array(line[3]), 50)) for line in lines], "rep long, n int, tokens array<bigint>, dfs array<int>, l int, take int")
    placed = [(t, r, n, l, k, n, r, False) for r, n, ts, _, l, m in classes.collect() for k, t in enumerate(ts[:m])]
    placed = spark.createDataFrame(placed, "token long, rep long, n int, l int, k int, m int, comp long, main boolean")
    got = {(r.a, r.b): (r.met, r.needed) for r in nd._met(placed, classes, 50).collect()}
    lead = {r.rep: set(r.tokens[: r["take"]]) for r in classes.collect()}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 50 * len(set(sets[a]) | set(sets[b]))}
    assert linked and linked <= set(got)
    assert all(met == len(lead[a] & lead[b]) and met >= needed for (a, b), (met, needed) in got.items() if (a, b) in linked)


def test_a_hot_element_is_summed_before_it_is_sent(spark):
    """A million documents with one element in common: a bucket gets a few bytes for each batch of texts."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(50_000), pa.int64()), pa.array([f"a b c d e {i}" for i in range(50_000)])], names=["__id", "__text"])
    sent = list(nd._sender(5, 0)(iter([batch])))
    hot = sum(len(x) for part in sent for x in part.column(3).to_pylist() if x)
    assert hot == 12 * len(sent) and sum(part.num_rows for part in sent) == 2 * len(sent)
    back = nd._counter(0)(pa.Table.from_batches(sent))
    assert np.frombuffer(back.filter(back["back"].is_valid())["back"].to_pylist()[0], nd._BACK)["df"].tolist() == [50_000]


def test_hashes_come_whole_through_any_number_of_buckets(spark):
    """What a bucket's number tells of a hash isn't sent, and is put back."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = [f"a b c d e f{i % 7} g{i % 11}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["__id", "__text"])
    want = None
    for lead in (0, 3, 8, 13, 17):
        sent = pa.Table.from_batches(list(nd._sender(5, lead)(iter([batch.slice(0, 150), batch.slice(150)]))))
        found = set()
        for b in pc.unique(sent["bucket"]).to_pylist():
            back = nd._counter(lead)(sent.filter(pc.equal(sent["bucket"], b)))
            for x in back["back"].to_pylist():
                found |= {tuple(r)[:2] for r in (np.frombuffer(x, nd._BACK).tolist() if x else [])}
        assert want is None or found == want
        want = found
    assert len(want) == 1 + 7 + 77


def test_tables_are_deleted(spark, tmp_path, monkeypatch):
    from marginalia.sources import tables

    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}")
    found = near_duplicates(spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h")], "doc_id long, text string"))
    assert found.count() == 2 and [p.name.split("-")[:2] for p in tmp_path.iterdir()] == [["near", "duplicates"]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=25, unique=True), st.lists(st.integers(0, 40), min_size=1, max_size=25, unique=True), st.integers(50, 100), st.lists(st.integers(2, 30), min_size=41, max_size=41))
def test_prefixes_lose_nothing(a, b, percent, df):
    """Any two sets that link share min(l, l') elements of their prefixes."""
    n = len(set(a) & set(b))
    if 100 * n < percent * len(set(a) | set(b)):
        return
    order = lambda s: sorted(s, key=lambda x: (df[x], x))
    a, b = order(a), order(b)
    la, ma = prefix_of(len(a), np.array([df[x] for x in a]), percent)
    lb, mb = prefix_of(len(b), np.array([df[x] for x in b]), percent)
    assert la and lb and len(set(a[:ma]) & set(b[:mb])) >= min(la, lb)


def test_components(spark):
    pick = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(pick.randrange(90), pick.randrange(90)) for _ in range(60)] + [(5, 5), (200, 199), (199, 200)]
    part = {v: v for p in pairs for v in p if p[0] != p[1]}
    for _ in part:
        for a, b in pairs:
            if a != b:
                part[a] = part[b] = min(part[a], part[b])
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.v: r.comp for r in got} == part
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_lists_are_split_by_their_length(spark):
    from marginalia.llm.shared import Scratch

    n = 70_000
    postings = spark.range(n).selectExpr("7L as token", f"{nd._MOST_DF} as df", "id as rep").union(spark.range(5000).selectExpr("8L", "5000", "id")).union(spark.range(10).selectExpr("9L", "10", "id"))
    scratch = Scratch(spark)
    parted = nd._parted(postings, scratch)
    sizes = {(r.token, r.part): r["count"] for r in parted.groupBy("token", "part").count().collect()}
    assert sum(sizes.values()) == n + 5010 and len([k for k in sizes if k[0] == 7]) == 18 and max(sizes.values()) < 1.1 * nd.CHAIN
    assert {k for k in sizes if k[0] > 7} == {(8, 0), (8, 1), (9, 0)} and parted.columns == [*postings.columns, "part"]
    scratch.close()


def test_rows_of_one_id_with_two_texts(spark):
    a, b, c = ("the first of the texts with some words", "another text that has nothing of it at all", "a third one which is not like those before")
    docs = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (6, b, "p"), (7, c, "q"), (7, c, "r"), (None, a, "s"), (8, None, "t"), (8, a, "u"), (9, None, "v")]
    df = spark.createDataFrame(docs, "doc_id long, text string, `an.other` string")
    kept = nd.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r[2] for r in kept.collect()) == ["q", "r", "s", "t", "v", "x", "z"]
    once = df.where("doc_id in (3, 6, 7)")
    assert sorted(r[2] for r in nd.without_near_duplicates(once).collect()) == ["p", "q", "r", "x"]
    assert nd.without_near_duplicates(df.limit(0)).count() == 0
