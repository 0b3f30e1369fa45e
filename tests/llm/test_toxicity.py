import math
import re

import numpy as np

from marginalia.llm.toxicity import fit_ordinal, score, train


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train(docs, labels.where("doc_id % 2 = 0"))
    rest = labels.where("doc_id % 2 = 1").join(score(docs, model).withColumnRenamed("toxic", "said"), "doc_id").collect()
    right = {y: np.mean([r.said == bool(y) for r in rest if r.toxic == y]) for y in (0, 1)}
    # about one in eight of these toxic labels stands on a text without any toxic word
    assert right[1] > 0.85 and right[0] > 0.99
    assert all(np.diff(model.thresholds) > 0)


def test_against_plain_scoring(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert len(model.keys)
    words = re.compile(rb"[0-9a-z\x80-\xff]+")
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    from marginalia.llm.toxicity import again, features

    def f(x):
        return set(features(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[1].tolist())

    rows = {r.doc_id: r for r in score(docs, model).collect()}
    for d in docs.limit(80).collect():
        each = [h for w in words.findall(d.text.encode().lower()) for h in f(w)] if d.text else []
        got = set(each) | {int(again(np.array([h], np.uint64))[0]) for h in set(each) if each.count(h) > 1}
        m = sum(weight.get(h, 0) for h in got)
        want = sum(1 / (1 + math.exp(-(m - t))) for t in model.thresholds)
        assert abs(rows[d.doc_id].severity - want) < 1e-9


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3)) < 0.5
    eta = x @ np.array([4.0, 2.0, -3.0]) + rng.logistic(size=800)
    grades = (eta > 1).astype(int) + (eta > 4)
    r, c = np.nonzero(x)
    w, t = fit_ordinal(r, c, grades, 3, 3, penalty=1e-5)
    assert np.allclose(w, [4, 2, -3], atol=0.8) and t[0] < t[1] and np.allclose(t, [1, 4], atol=0.8)


def test_edge_cases(spark):
    docs = [(i, f"you loser moron scum {i}") for i in range(30)] + [(100 + i, f"lovely weather {i}") for i in range(30)]
    labels = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(None, 1), (5, None), (5, 0), (999, 1)]
    d = spark.createDataFrame(docs + [(None, "loser moron scum"), (201, None), (202, ""), (203, "x " * 50_000 + "Loser, moron: scum!"), (203, "fine"), (203, "fine")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(d, lab)
    rows = score(d, model).collect()
    assert len(rows) == 66
    toxic = [r for r in rows if r.toxic]
    assert {r.doc_id for r in toxic} == {*range(30), None, 203} and len(toxic) == 32
    assert not any(r.toxic for r in score(d, train(d, lab.where("toxic = 0"))).collect())
    assert score(d.limit(0), train(d.limit(0), lab.limit(0))).count() == 0
    odd = d.withColumnsRenamed({"doc_id": "severity", "text": "grade"})
    assert score(odd, model, "severity", "grade").count() == 66


def plain_features(text):
    """Distinct words, the first 4 and first 5 bytes of longer words, and which of these occur more than once."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    found = [("w", w) for w in words] + [(n, w[:n]) for w in words for n in (4, 5) if len(w) > n]
    return set(found) | {("twice", f) for f in set(found) if found.count(f) > 1}


def test_features_against_plain(spark):
    """Features of whole texts are the plain ones, one hash for each and each hash for one."""
    from marginalia.llm.toxicity import again, distinct, features

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", "Ab ab AB abcd abcde abcdef ÄÖ 12x", "a" * 5000 + " " + "a" * 5001]
    known = {}
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        got = set(distinct(*features(data, np.array([0, len(data)])))[1].tolist())
        want = plain_features(t)
        assert len(got) == len(want)
        for f in [x for x in want if x[0] != "twice"]:
            alone = f[1] if f[0] == "w" else f[1] + b"zz"
            h = features(np.frombuffer(alone, np.uint8), np.array([0, len(alone)]))[1].tolist()
            known.setdefault(f, h[0] if f[0] == "w" else h[1 if f[0] == 4 else -1])
        twice = {int(again(np.array([known[f]], np.uint64))[0]) for kind, f in want if kind == "twice"}
        assert got == {known[f] for f in want if f[0] != "twice"} | twice
    assert len(set(known.values())) == len(known)


def test_training_uses_plain_counts(spark):
    """Which features are kept and the grades follow from counts over the sample; a repeated id counts once."""
    rng = np.random.default_rng(1)
    docs = []
    for i in range(160):
        w = rng.choice(["sun", "rain", "wind", "cloud", "river"], 6).tolist()
        w += (["vile"] * int(i % 4 != 3) + ["filth"] * int(i % 3 == 0)) if i < 80 else (["garden"] * int(i % 5 != 0))
        docs.append((i, " ".join(w)))
    labels = [(i, int(i < 80)) for i in range(160)]
    d, lab = spark.createDataFrame(docs * 3 + [(5, "a later text")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(d, lab)
    least = dict(docs) | {5: min(dict(docs)[5], "a later text")}
    sets = {i: plain_features(t) for i, t in least.items()}
    want = set()
    for f in set().union(*sets.values()):
        a, b = sum(f in sets[i] for i in range(80)), sum(f in sets[i] for i in range(80, 160))
        pa, pb, both = a / 80, b / 80, (a + b + 1) / 160
        z = (pa - pb) / math.sqrt(both * (2 / 80))
        if max(a, b) >= 4 and ((z >= 5 and pa >= 4 * pb) or (z <= -5 and pb >= 4 * pa)):
            want.add(f)
    assert {x for _, x in want} >= {b"vile", b"filth", b"garden"} and len(model.keys) == len(want)
    from marginalia.llm.toxicity import features

    word = {w: features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1][0] for w in (b"vile", b"garden")}
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    assert weight[int(word[b"vile"])] > 0 > weight[int(word[b"garden"])]


def test_grades_on_held_out_rows(spark):
    """Grades are derived (3 and 6 strong features); how many of the held-out toxic rows get the one so derived."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half, full = train(docs, labels.where("doc_id % 2 = 0")), train(docs, labels)
    a = {r.doc_id: r.grade for r in score(docs, half).collect()}
    b = {r.doc_id: r.grade for r in score(docs, full).collect()}
    toxic = [r.doc_id for r in labels.where("doc_id % 2 = 1 and toxic = 1").collect()]
    same = np.mean([a[i] == b[i] for i in toxic])
    print("grades of held-out toxic rows as by a model of all labels:", same, {g: sum(a[i] == g for i in toxic) for g in range(4)})
    assert same > 0.8 and np.mean([abs(a[i] - b[i]) <= 1 for i in toxic]) > 0.95
