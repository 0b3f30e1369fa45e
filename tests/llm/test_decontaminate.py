import re

from compare import differ, oracle

from marginalia.llm.decontaminate import decontaminate, op9_decontamination, without_hits
from marginalia.llm.queries import ORACLE_SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for a in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for s in sizes:
            for a in range(len(w) - s + 1):
                if (x := tuple(w[a : a + s])) in windows:
                    hit |= set(range(a, a + s))
                    found |= windows[x]
        out.append((d, len(w), len(hit), tuple(sorted(found, key=str))))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect()), key=str)


def test_against_brute_force_and_blocks(spark):
    base = "sf0.001"
    docs = spark.read.parquet(f"/root/testdata/{base}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"/root/testdata/{base}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert rows(decontaminate(docs, bench)) == want
    assert any(x[2] for x in want)
    assert rows(decontaminate(docs, bench, block_bytes=3000)) == want


def test_edge_cases(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = [(1, None), (2, ""), (3, item.upper()), (3, item.upper()), (None, "tiny Item!"), (4, "x " + " ".join(item.split()[2:12]) + " y"), (5, "a b c " * 50_000 + "tiny item"), (6, "é a'b")]
    items = [(1, item), (1, "other words"), (2, "tiny item"), (3, None), (4, "..."), (5, item), (6, "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate(d, b)) == brute(docs, items)
    assert rows(decontaminate(d, b.limit(0))) == brute(docs, [])
    assert decontaminate(d.limit(0), b).count() == 0


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "tiny item", 5)], "n_words long, items string, __text long")
    b = spark.createDataFrame([(2, "tiny item")], "item_id long, text string")
    r = decontaminate(d, b, id_col="n_words", text_col="items").toPandas()
    assert r.iloc[0, 2] == 2


def test_items_without_an_id(spark):
    docs = [(1, "x tiny item y"), (2, "other words here"), (3, "tiny item other words"), (4, "none")]
    items = [(None, "tiny item"), (None, "other words"), (7, "tiny item")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows(decontaminate(d, b)) == want and (2, 3, 2, (None,)) in want
    assert rows(decontaminate(d, b, block_bytes=8)) == want
    assert [r.doc_id for r in without_hits(d, b).collect()] == [4]


def test_query_and_sql_agree_on_items_without_an_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x tiny item y"), (2, "other words here"), (3, "tiny item other words"), (4, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "tiny item"), (None, "other words"), (7, "tiny item")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert differ(op9_decontamination(spark, str(tmp_path)), oracle(str(tmp_path)), ORACLE_SQL["op9_decontamination"]) is None


def test_words_decide_not_hashes(spark, monkeypatch):
    """Words of regular structure, and a hash that confuses everything of one length: the words themselves are compared."""
    from test_near_duplicates import thue_morse

    from marginalia.llm import words as W

    x, y = thue_morse("a", "b", 4096)
    docs = [(1, "".join(x) + " s t"), (2, "".join(y) + " s t"), (3, " ".join(x)), (4, " ".join(y)), (5, "p q r"), (6, "p q s")]
    items = [(1, "".join(x)), (2, "".join(x) + " s"), (3, "p q r"), (4, "q s"), (5, "s t"), (6, "t s")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows(decontaminate(d, b)) == want and want[1][2:] == (2, (5,))
    from marginalia.llm import decontaminate as module

    w = W.words_of(*W.texts(__import__("pyarrow").array([t for _, t in docs])), inside=W.ALNUM, lower=True)
    monkeypatch.setattr(W.Words, "windows", lambda self, size: self.hash * W.U(0) + W.U(size))
    block = module.Block([i for i, _ in items], [t for _, t in items], 10)
    of = w.text_of()
    got = {(docs[of[p]][0], block.ids[i]) for size, at, which in block.hits(w) for p, j in zip(at.tolist(), which.tolist(), strict=True) for i in block.windows[size][3][block.windows[size][2][j] : block.windows[size][2][j + 1]].tolist()}
    assert got == {(d, i) for d, _, _, found in want for i in found}


def test_ids_of_other_types(spark):
    docs = [("a", "x tiny item y"), ("b", "other words here"), (None, "tiny item other words")]
    items = [("x2", "tiny item"), ("x10", "other words"), (None, "tiny item")]
    d, b = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    for size in (8 << 20, 8):
        assert rows(decontaminate(d, b, block_bytes=size)) == sorted([("a", 4, 2, ("x2", None)), ("b", 3, 2, ("x10",)), (None, 4, 4, ("x10", "x2", None))], key=str)
    assert decontaminate(d, b).schema["items"].dataType.simpleString() == "array<string>"


def test_one_block_at_a_time(spark, monkeypatch):
    """Every block but the last is done with, and its result written, before the next one comes to the driver."""
    from marginalia.llm import decontaminate as module

    steps, made, write = [], module.Block, module.Scratch.write
    monkeypatch.setattr(module, "Block", lambda *a: steps.append("block") or made(*a))
    monkeypatch.setattr(module.Scratch, "write", lambda *a: steps.append("pass") or write(*a))
    d = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "five")], "doc_id long, text string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "two one", "three four", "six"])], "item_id long, text string")
    assert [r.doc_id for r in without_hits(d, b, block_bytes=8).collect()] == [3]
    assert steps == ["block", "pass"] * (len(steps) // 2) + ["block"] and len(steps) > 2
