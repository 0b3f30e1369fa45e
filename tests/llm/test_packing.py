import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.packing import best_fit, default_tokenizer, pack, packed, tokenized


def plain_best_fit(lengths, capacity, max_open):
    open_bins, out, made = [], [], 0  # [free, number], in order of the last change
    for n in lengths:
        fits = [b for b in open_bins if b[0] >= n]
        if fits:
            least = min(b[0] for b in fits)
            b = [b for b in fits if b[0] == least][-1]
            open_bins.remove(b)
        else:
            if len(open_bins) == max_open:
                least = min(b[0] for b in open_bins)
                open_bins.remove([b for b in open_bins if b[0] == least][-1])
            b, made = [capacity, made], made + 1
        out.append((b[1], capacity - b[0]))
        b[0] -= n
        if b[0]:
            open_bins.append(b)
    return [x[0] for x in out], [x[1] for x in out], made


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 6))
def test_best_fit_against_plain(lengths, max_open):
    assert best_fit(lengths, 20, max_open) == plain_best_fit(lengths, 20, max_open)


def direct(docs, max_len):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    out = []
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out += [(d, p, s, ids[s : s + max_len]) for p, s in enumerate(range(0, len(ids), max_len))]
    return sorted(out, key=str)


def checked(rows, want, max_len):
    got = sorted(((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=str)
    assert got == want
    at = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= max_len
    return len(at)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = direct([tuple(r) for r in docs.collect()], 4096)
    n = checked(pack(docs, default_tokenizer()).collect(), want, 4096)
    assert n <= 1.1 * sum(len(x[3]) for x in want) / 4096 + 1


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "İstanbul ΣΑΣ 's <|endoftext|> é́ x\x1cy  z"), (4, "again"), (4, "again"), (None, "b"), (5, "word " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    checked(pack(df, default_tokenizer(), max_len=64, max_open=2).collect(), direct(docs, 64), 64)
    assert pack(df.limit(0), default_tokenizer()).count() == 0
    with pytest.raises(ValueError):
        tokenized(df, default_tokenizer(), 0)


def test_groups_and_names(spark):
    df = spark.createDataFrame([(i, "a b c") for i in range(50)], "n long, key string")
    pieces = tokenized(df, default_tokenizer(), 8, id_col="n", text_col="key")
    r = packed(pieces, 8, group_pieces=10).collect()
    assert len(r) == 50 and len({x.sequence_id >> 36 for x in r}) == 5


def test_a_tokenizer_of_another_make(spark):
    """One that keeps white space and case encodes whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    docs = [(1, "Two  Words\n\nand  more"), (2, None), (3, " x" * 3000), (4, "Ünï ©ode \t tab")]
    want = sorted(((d, p, s, ids[s : s + 1000]) for d, text in docs for ids in [[*t.encode(text or "", add_special_tokens=False).ids, 7]] for p, s in enumerate(range(0, len(ids), 1000))), key=str)
    rows = tokenized(spark.createDataFrame(docs, "doc_id long, text string"), path, 1000, 7).collect()
    assert sorted(((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=str) == want
