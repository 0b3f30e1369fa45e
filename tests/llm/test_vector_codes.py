import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.queries import ORACLE_SQL
from marginalia.llm.vector_codes import Codebook, VectorCodes, op11_vector_codes, with_label_errors

DIR = "/root/testdata/sf0.001"


def plain(rows, parts, entries, rounds, scale=1024):
    """(id, code, error) of each kept row in order of id, and the codebooks."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = len(kept[0][1]) // parts if kept else 0
    cut = [[v[p * wide : (p + 1) * wide] for _, v in kept] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [near(books[p], x)[1] for x in cut[p]]
            for k in range(len(books[p])):
                own = [x for x, o in zip(cut[p], of, strict=True) if o == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for n, (i, _) in enumerate(kept):
        told = [near(books[p], cut[p][n]) for p in range(parts)]
        out.append((i, bytes(k for _, k in told), sum(d for d, _ in told)))
    return out, books


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5), st.integers(1, 120), st.integers(1, 200), st.sampled_from([2, 9, 1000, 1 << 27]), st.integers(0, 2**32))
def test_search_against_all_entries(dim, entries, n, most, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-most, most + 1, (entries, dim)), rng.integers(-most, most + 1, (n, dim))
    code, best = Codebook(book).nearest(x)
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (code == d.argmin(axis=1)).all()


def test_search_leaves_entries_out(monkeypatch):
    rng = np.random.default_rng(1)
    book, x = rng.integers(0, 1000, (256, 1)) * 50, rng.integers(0, 50_000, (5000, 1))
    seen = []
    compare = Codebook._compare
    monkeypatch.setattr(Codebook, "_compare", lambda self, x, a, b, small: seen.append(len(x) * (b - a)) or compare(self, x, a, b, small))
    code, _ = Codebook(book).nearest(x)
    assert (code == ((x - book[:, 0]) ** 2).argmin(axis=1)).all() and sum(seen) < 0.5 * len(x) * len(book)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i % 23, [((i * 7 + j * 5) % 11 - 5) / 1000 for j in range(8)]) for i in range(60)]
    rows += [(1, None), (2, [nan] * 8), (3, [0.0] * 7 + [inf]), (4, [None] + [0.0] * 7), (5, []), (None, [0.5] * 8), (None, [-0.5] * 8), (6, [-1e-9] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, code string, `a.b` int").repartition(5)
    for entries in (5, 256):
        codes = VectorCodes(df, parts=4, entries=entries, rounds=3, keep=("a.b",))
        want, books = plain(rows, 4, entries, 3)
        assert [b.tolist() for b in codes.codebooks] == books
        assert sorted(((r[0], bytes(r[2]), r[3]) for r in codes.rows().collect()), key=str) == sorted(want, key=str)
        assert codes.digest() == hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    other = df.union(spark.createDataFrame([(0, [0.0] * 4, "x", 1), (99, [0.0] * 12, "x", 1)], df.schema))
    assert VectorCodes(other.where("vec_id > 0 or size(embedding) = 8"), rounds=1).rows().where("vec_id = 99").count() == 0
    empty = VectorCodes(df.limit(0), keep=("a.b",))
    assert empty.rows().columns == ["vec_id", "a.b", "code", "error"] and empty.rows().count() == 0
    with pytest.raises(ValueError):
        VectorCodes(df, parts=3)
    with pytest.raises(ValueError):
        VectorCodes(df, keep=("code",))
    huge = spark.createDataFrame([(1, [1e300, -1e300, 0.0, 1.0]), (2, [1.0, 1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert VectorCodes(huge, entries=1, rounds=0).rows().where("error < 0").count() == 0


def test_label_errors(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, None, 5), (4, None, 7), (5, "b", 2**62), (6, "b", 2**62)], "vec_id long, label string, error long")
    assert {r.vec_id: r.label_error for r in with_label_errors(rows).collect()} == {1: 5, 2: 5, 3: 12, 4: 12, 5: None, 6: None}


def test_query_against_sql(spark):
    from compare import differ, oracle

    assert differ(op11_vector_codes(spark, DIR), oracle(DIR), ORACLE_SQL["op11_vector_codes"]) is None
