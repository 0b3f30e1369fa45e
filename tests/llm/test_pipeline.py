import corpus_pipeline as P
from test_decontaminate import brute as hits
from test_near_duplicates import brute as components

from marginalia.llm import pii, toxicity
from marginalia.llm.shared import written


def test_every_stage_against_plain_versions(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("toxic").collect()}
    rows = [r for r in rows if r[0] not in toxic]
    assert toxic and len(rows) > 900
    rows = [r for r, c in zip(sorted(rows, key=str), components(rows), strict=True) if r[0] == c[2]]
    bench = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    bad = {x[0] for x in hits(rows, bench) if x[2]}
    rows = [r for r in rows if r[0] not in bad]
    field = pii.train()
    rows = {i: pii.mask(t, pii.spans_of([t], field)[0][1]) for i, t in rows}

    out = docs
    kept = []
    for name, stage in P.STAGES[:4]:
        out = written(stage(spark, out, d), name)
        assert out.columns == docs.columns
        kept.append(out.count())
    assert kept == sorted(kept, reverse=True) and kept[0] > kept[1] > kept[2] == kept[3]
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, t in rows.items()}
    packed = P.STAGES[4][1](spark, out, d).collect()
    assert {r.doc_id for r in packed} == set(rows) and all(len(r.ids) == 4 * r.length <= 4 * 4096 for r in packed)


def test_nulls_and_extra_rows(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, None, "en", None, 3), (9002, "", None, "s", None), (None, "a b", "en", "s", 3)], docs.schema)
    out = docs.unionByName(odd)
    for name, stage in P.STAGES:
        out = written(stage(spark, out, d), name)
    assert sorted(r.doc_id for r in out.where("doc_id > 9000").collect()) == [9001, 9002] and out.where("doc_id is null").count() == 2
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        empty = written(stage(spark, empty, d), name)
    assert empty.count() == 0
