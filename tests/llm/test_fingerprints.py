import hashlib
import re

import pytest
import xxhash

from marginalia.llm.fingerprints import as_string, fingerprints, op8_fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run_hash(run):
    """A cyclic polynomial: the words' hashes, each turned by a bit for every word after it, added bit by bit."""
    s = 0
    for turns, w in enumerate(reversed(run)):
        h, turns = xxhash.xxh64_intdigest(w.encode(), seed=42), turns % 64
        s ^= (h << turns | h >> (64 - turns)) & (1 << 64) - 1
    return s >> 31


def plain(text, k=5, window=8):
    w = WORD.findall(text)
    if not w:
        return []
    g = [run_hash(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    out = []
    for a in range(max(1, len(g) - window + 1)):
        part = g[a : a + window]
        i = a + max(j for j, h in enumerate(part) if h == min(part))
        if not out or out[-1][1] != i:
            out.append((g[i], i))
    return out


def jaccard(a, b):
    a, b = {x[0] for x in a}, {x[0] for x in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0], d[1] or ""))
    texts = [t or "" for _, t in docs]
    out = []
    for i, (d, _) in enumerate(docs):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        m = len(t) // 4
        e = t[: len(t) - m] + nxt[:m]
        p, q = plain(t), plain(e)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), ",".join(f"{h:x}:{x}" for h, x in p), ",".join(f"{h:x}:{x}" for h, x in q), round(jaccard(p, q), 9), round(jaccard(p, plain(nxt)), 9)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = op8_fingerprints(spark, "/root/testdata/sf0.001")
    assert rows(df) == brute(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_edge_cases_and_ranges(spark, size):
    from pyspark.sql import functions as F

    docs = [(5, None), (1, ""), (None, "null id here"), (2, "a " * 300), (3, "é中\U0001f600" * 50), (3, "b"), (3, "b"), (9, " \t\n"), (10, "one two three four five six seven"), (-4, "x y"), (77, "w " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    r = fingerprints(df, range_bytes=size)
    r = r.select("doc_id", "n_chars", F.sha2("edited", 256), as_string(F.col("prints")), as_string(F.col("edited_prints")), "near_edited", "near_next")
    assert rows(r) == brute(docs)
    one = df.where("doc_id = 10")
    assert [x.near_next for x in fingerprints(one).collect()] == [1.0]
    assert fingerprints(df.limit(0)).count() == 0
    odd = one.withColumnsRenamed({"doc_id": "edited", "text": "n_chars"})
    assert fingerprints(odd, id_col="edited", text_col="n_chars").count() == 1
