from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.packing import default_tokenizer
from marginalia.llm.token_counts import END, LongestMatch, pieces_of, token_counts


def greedy(pieces, word):
    pieces = set(pieces) | {(END,)}
    longest = max(map(len, pieces))
    rest, n = (*word, END), 0
    while rest:
        for k in range(min(longest, len(rest)), 0, -1):
            if rest[:k] in pieces:
                n += rest[:k] != (END,)
                rest = rest[k:]
                break
        else:
            return 1
    return n


letters = st.lists(st.integers(0, 2), min_size=1, max_size=5)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(letters, st.booleans()), max_size=12), st.lists(st.integers(0, 2), min_size=1, max_size=20))
def test_automaton_against_greedy(vocabulary, word):
    pieces = [(*p, *[END] * e) for p, e in vocabulary]
    assert LongestMatch(pieces).count(bytes(word)) == greedy(pieces, word)


def test_whole_table_and_edge_cases(spark):
    pieces = pieces_of(open(default_tokenizer(), encoding="utf-8").read())
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = docs[:60] + [(900, None), (901, ""), (902, " \n"), (903, "Été \x00 中文 İ"), (904, "a" * 3000), (904, "x"), (904, "x"), (None, "b")]
    seen = {}
    want = []
    have = set(pieces) | {(END,)}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        for x in w:
            if x not in seen:
                rest, n = (*x, END), 0
                while rest:
                    k = next(k for k in range(min(80, len(rest)), 0, -1) if rest[:k] in have)
                    n += rest[:k] != (END,)
                    rest = rest[k:]
                seen[x] = n
        want.append((d, len(w), sum(seen[x] for x in w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in token_counts(df, default_tokenizer()).collect()), key=str) == sorted(want, key=str)
    assert token_counts(df.limit(0), default_tokenizer()).count() == 0
    odd = df.withColumnRenamed("doc_id", "n_words").withColumnRenamed("text", "n_tokens")
    assert token_counts(odd, default_tokenizer(), "n_words", "n_tokens").count() == len(docs)
