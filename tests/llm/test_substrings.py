import re

from marginalia.llm.substrings import FingerprintLog, op7_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, size):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in split:
        for a in range(len(w) - size + 1) if d is not None else ():
            x = tuple(w[a : a + size])
            first[x] = min(first.get(x, d), d)
    out = []
    for d, w in split:
        gone = set()
        for a in range(len(w) - size + 1) if d is not None else ():
            if first[tuple(w[a : a + size])] < d:
                gone |= set(range(a, a + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r[0], r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()], 50)
    log = FingerprintLog(spark)
    log.append(docs)
    assert rows(log.dedup(docs)) == want
    assert sum(x[2] for x in want)


def test_batches_compaction_and_small_windows(spark):
    import random

    pick = random.Random(1)
    passage = [pick.choice("abcdefgh") for _ in range(30)]
    docs = []
    for i in range(120):
        w = [pick.choice("abcdefgh") for _ in range(pick.randrange(40))]
        at = pick.randrange(25)
        docs.append((i, " ".join(w[: len(w) // 2] + passage[at : at + pick.randrange(30)] + w[len(w) // 2 :])))
    docs += [(None, docs[3][1]), (200, None), (201, ""), (201, docs[5][1]), (201, docs[5][1]), (202, " \n"), (203, "a " * 3000), (204, "a " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 8)
    log = FingerprintLog(spark, size=8, k=3, max_runs=2)
    for low, high in ((0, 30), (30, 60), (60, 90), (90, 1000)):
        log.append(df.where(f"doc_id >= {low} and doc_id < {high}"))
    assert len(log.runs) <= 2
    assert rows(log.dedup(df)) == want
    late = rows(log.dedup(df.where("doc_id >= 60"), df))
    assert late == [x for x in want if x[0] is not None and x[0] >= 60]
    again = FingerprintLog(spark, log.path, log.runs, 8, 3)
    assert rows(again.dedup(df)) == want


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "kept long, anchor string, n_words string")
    log = FingerprintLog(spark)
    log.append(df, "kept", "anchor")
    assert [r[1] for r in log.dedup(df, None, "kept", "anchor").collect()] == [2]
    assert log.dedup(df.limit(0), df, "kept", "anchor").count() == 0


def test_batches_are_taken_one_after_another(spark):
    import random

    pick = random.Random(3)
    passage = [pick.choice("abcdefgh") for _ in range(30)]
    docs = [(i, " ".join([pick.choice("abcdefgh") for _ in range(pick.randrange(30))] + passage[pick.randrange(15) :])) for i in range(60)]
    docs += [(None, docs[3][1]), (60, docs[5][1]), (60, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    log = FingerprintLog(spark, size=8, k=3, max_runs=2)
    found = rows(log.take(df.where("doc_id < 15 or doc_id is null")))
    for low in (15, 30, 45):
        found += rows(log.take(df.where(f"doc_id >= {low} and doc_id < {low + 15 + (low == 45)}"), df.where(f"doc_id < {low + 15 + (low == 45)}")))
    assert sorted(found, key=str) == brute(docs, 8) and len(log.runs) <= 2


def test_the_query_takes_batches(spark, monkeypatch):
    taken, take = [], FingerprintLog.take
    compacted, compact = [], FingerprintLog.compact
    monkeypatch.setattr(FingerprintLog, "compact", lambda self: compacted.append(len(self.runs)) or compact(self))
    monkeypatch.setattr(FingerprintLog, "take", lambda self, docs, *a: taken.append({r[0] for r in docs.select("doc_id").collect()}) or take(self, docs, *a))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.n_words, r.n_removed) for r in op7_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {x[:3] for x in brute([tuple(r) for r in docs.collect()], 50)}
    assert len(taken) == 6 and all(max(a) < min(b) for a, b in zip(taken[:-1], taken[1:], strict=True)) and compacted == [5]


def test_windows_that_regular_words_could_confuse(spark):
    from test_near_duplicates import thue_morse

    x, y = thue_morse("a", "b", 2048)
    words = [f"w{i}" for i in range(49)]
    docs = [(1, " ".join([*words, "".join(x)])), (2, " ".join([*words, "".join(y)])), (3, " ".join(x)), (4, " ".join(y)), (5, " ".join(["".join(y), *words]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    log = FingerprintLog(spark)
    want = brute(docs, 50)
    assert rows(log.take(df)) == want and want[1][2] == 0


def test_a_batch_reads_only_documents_with_its_anchors_again(spark, monkeypatch):
    """Of the history, the window by window part sees the documents that had the anchors of new segments first."""
    import random

    from marginalia.llm import substrings

    pick = random.Random(4)
    docs = [(i, " ".join(pick.choice("abcdefghijklmnopqrstuvwxyz") + str(pick.randrange(99)) for _ in range(40))) for i in range(50)]
    docs += [(50, " ".join(docs[7][1].split()[5:30]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    log = FingerprintLog(spark, size=8, k=3)
    log.take(df.where("doc_id < 50"))
    read, write = [], substrings.Scratch.write
    monkeypatch.setattr(substrings.Scratch, "write", lambda self, d, name: read.append((name, out := write(self, d, name), out.count())) or out)
    assert rows(log.take(df.where("doc_id = 50"), df)) == [x for x in brute(docs, 8) if x[0] == 50]
    assert {name: n for name, _, n in read}["wanted"] <= 2
