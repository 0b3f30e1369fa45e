import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.sentence_pieces import Pieces, decode, default_model, encode, op12_sentencepiece

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def pieces():
    with open(default_model(), "rb") as f:
        return Pieces(f.read())


letters = st.text(st.one_of(st.sampled_from("ab  ▁\n\t　.1<>s/é中\x00🙂"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=1500, deadline=None)
@given(letters)
def test_ids_and_texts_are_the_librarys(pieces, library, text):
    assert pieces.by_chunks
    ids = library.encode(text, add_eos=True)
    assert pieces.ids([text])[0].tolist() == ids
    assert pieces.text(ids) == library.decode(ids)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.sampled_from([28705, 259, 264]), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_the_library_does(pieces, library, ids):
    assert pieces.text(ids) == library.decode(ids)


def test_whole_texts_where_chunks_are_tied(pieces, library):
    whole = Pieces(open(default_model(), "rb").read())
    whole.by_chunks = False
    for text in ("", " a  b ", "x▁y", "中文 abc"):
        assert whole.ids([text])[0].tolist() == library.encode(text, add_eos=True) == pieces.ids([text])[0].tolist()
        assert whole.text(library.encode(text)) == library.decode(library.encode(text))


def test_small_table(library):
    for cached in (1, 3, 40):
        small = Pieces(open(default_model(), "rb").read(), cached)
        for i in range(60):
            texts = ["one two three four five", "", f"six {i} " + "x" * 500 * (i % 3), "one " * 50, f"{i // 2} a{i} "]
            flat, sizes = small.ids(texts)
            assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [library.encode(t, add_eos=True) for t in texts]
            assert len(small.table.numbers) <= cached + 20


def test_edge_cases(spark, library):
    rows = [(1, None), (2, ""), (3, " "), (None, "a  b"), (4, "x"), (4, "x"), (5, "word " * 100_000), (6, "y" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = decode(encode(df, default_model()), default_model()).collect()
    want = [(d, tuple(library.encode(t or "", add_eos=True)), library.decode(library.encode(t or "", add_eos=True))) for d, t in rows]
    assert sorted(((r.doc_id, tuple(r.ids), r.decoded) for r in found), key=str) == sorted(want, key=str)
    assert encode(df, default_model(), end=False).where("doc_id = 2").first().ids == []
    assert encode(df.limit(0), default_model()).count() == 0
    odd = df.withColumnsRenamed({"doc_id": "ids", "text": "decoded"}).selectExpr("*", "1 as __id", "2 as `a.b`")
    assert encode(odd, default_model(), id_col="ids", text_col="decoded").count() == len(rows)
    lists = spark.createDataFrame([(1, None), (2, [264, None, 287]), (3, [99_999, -1])], "doc_id long, ids array<int>")
    assert [r.decoded for r in decode(lists, default_model()).orderBy("doc_id").collect()] == ["", "a b", library.decode([0, 0])]


def test_query(spark, library):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = []
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        want.append((d.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, op12_sentencepiece(spark, DIR).collect())) == sorted(want)
