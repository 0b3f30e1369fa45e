import hashlib
import re
import zlib
from itertools import groupby, product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import conversations as C
from marginalia.llm.shared import Scratch

DIR = "/root/testdata/sf0.001"
GOOD = re.compile("(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def every(symbols, most):
    """Cost and audit of the best of all sequences of edits with at most `most` inserted rows in each place."""
    initials = "sua?"
    gaps = [x for n in range(most + 1) for x in product("ua", repeat=n)]
    best = None
    choices = []
    for s in symbols:
        own = [("D", "", 4)]
        if s:
            kind, cut = divmod(s - 1, 2)
            own += [("K", initials[kind], 3 * cut), ("R", "u", 3 + 3 * cut), ("R", "a", 3 + 3 * cut)]
        choices += [[("I" * len(g), "".join(g), 3 * len(g)) for g in gaps], own]
    choices.append([("I" * len(g), "".join(g), 3 * len(g)) for g in gaps])
    for picked in product(*choices):
        if GOOD.fullmatch("".join(p[1] for p in picked)):
            told = (sum(p[2] for p in picked), "".join(p[0] for p in picked))
            best = told if best is None else min(best, told)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=3))
def test_against_all_edits(symbols):
    assert C.Grammar().solve([bytes(symbols)]) == [every(symbols, 2)]


def row_by_row(symbols):
    """The same by a plain walk over rows, with whole strings."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "")}

    def inserted(best):
        out = dict(best)
        for _ in range(4):
            for p, (cost, audit) in list(out.items()):
                for x in "ua":
                    if (p, x) in steps:
                        q, told = steps[p, x], (cost + 3, audit + "I")
                        out[q] = min(out.get(q, told), told)
        return out

    for s in symbols:
        after = {}
        for p, (cost, audit) in inserted(best).items():
            found = [(p, cost + 4, "D")]
            if s:
                kind, cut = divmod(s - 1, 2)
                found += [(steps[p, x], cost + c + 3 * cut, e) for x, c, e in (("sua?"[kind], 0, "K"), ("u", 3, "R"), ("a", 3, "R")) if (p, x) in steps]
            for q, c, e in found:
                told = (c, audit + e)
                after[q] = min(after.get(q, told), told)
        best = after
    ends = inserted(best)
    return min(ends[p] for p in ("", "a") if p in ends)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 8), max_size=40), st.lists(st.sampled_from([3, 5]), max_size=60), st.integers(0, 30).map(lambda n: [3, 5] * n)), max_size=12), st.integers(2, 4))
def test_grammar_against_row_by_row(sequences, least):
    grammar = C.Grammar(least)
    for _ in range(2):
        assert grammar.solve([bytes(s) for s in sequences]) == [row_by_row(s) for s in sequences]
    for s, c in zip(sequences, grammar.compressed([bytes(s) for s in sequences]), strict=True):
        back = {v: k for k, v in grammar.rules.items()}

        def spelt(x, back=back):
            return spelt(back[x][0]) + spelt(back[x][1]) if x in back else [x]

        assert [y for x in c for y in spelt(x)] == s


def test_rules_are_shared_and_forgotten():
    grammar = C.Grammar()
    long = bytes([3, 5] * 5000)
    (c,) = grammar.compressed([long])
    assert len(c) < 20 and grammar.solve([long]) == [(0, "K" * 10_000)]
    had = len(grammar.matrices)
    assert grammar.solve([long[:8000]]) == [(0, "K" * 8000)] and len(grammar.matrices) == had
    grammar.most = 0
    assert grammar.solve([long]) == [(0, "K" * 10_000)]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_ropes(data):
    had, C.LEAF = C.LEAF, 2
    try:
        pool = [(x, x) for x in data.draw(st.lists(st.text("DK", max_size=3), min_size=2, max_size=4))]
        for i, j in data.draw(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8)):
            (a, x), (b, y) = pool[i % len(pool)], pool[j % len(pool)]
            pool.append((C.joined(a, b), x + y))
        for a, x in pool:
            assert C.flat(a) == x
            for b, y in pool:
                assert C.less(a, b) == (x < y)
    finally:
        C.LEAF = had


def plain(rows, damage=True):
    """The contract, conversation by conversation."""
    out = {}

    def text_of(x):
        return " " if x is None else str(x)

    given = {}
    for conv, turn, role, text in rows:
        given.setdefault(conv, [])
        k = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20 if damage else 9
        role, text = text_of(role), text_of(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        row = (turn, "user" if k == 4 else role, text)
        given[conv] += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    for conv, mine in given.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in mine if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, symbols, n = set(), [], [0, 0, 0]
        for _, role, text in mine:
            body = text.strip(SPACES)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            symbols.append(0 if fault in (0, 1) else 1 + 2 * ("sua".find(role[0]) % 4 if role else 3) + (fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit = row_by_row(symbols)
        repaired, at = [], 0
        for e in audit:
            if e != "I":
                row, at = mine[at], at + 1
            due = "assistant" if repaired and repaired[-1][0][0] == "u" else "user"
            if e != "D":
                repaired.append((row[1] if e == "K" else due, "" if e == "I" else row[2]))
        assert GOOD.fullmatch("".join(r[0][0] for r in repaired)) and at == len(mine)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (conv, gaps, *n, illegal, cost, audit, sha)
    return sorted(out.values(), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, C.op13_conversation_repair(spark, DIR).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("segment", [4, 1 << 16])
def test_edge_cases(spark, tmp_path, batch, segment):
    roles = ["system", "user", "assistant", "tool", "", None, "s", "User"]
    texts = ["Yes.", "no", "", None, " \t", "really?\n", "x" * 50_000 + ".", " ", "Yes."]
    rows = [(c if c else None, None if i % 7 == 6 else (i * 3) % 11, roles[(i * c + i // 3) % 8 if c % 2 else 1 + i % 2], texts[(i * 5 + c) % 9]) for c in range(9) for i in range(c * 3)]
    rows += [(100, i, ("user", "assistant")[i % 2], f"turn {i}{'.' if i % 5 else ''}") for i in range(400)] + rows[:20] + [(200, None, "user", "a.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost long, `au.dit` string").repartition(5)
    path = str(tmp_path)
    df.write.parquet(f"{path}/conversations.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert sorted(map(tuple, C.op13_conversation_repair(spark, path).collect()), key=str) == plain(rows)
        scratch = Scratch(spark)
        whole = C.intact(df)
        told = {r.conv: r for r in C.judged(whole, scratch, segment).collect()}
        want = {r[0]: r for r in plain(rows, damage=False)}
        assert {k: tuple(v) for k, v in told.items()} == {k: v[:-1] for k, v in want.items()}
        assert told[100].blank == 0 and told[100].truncated == 80 and told[100].cost == 240
        scratch.close()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    empty = df.limit(0)
    empty.write.parquet(f"{path}/none/conversations.parquet")
    assert C.op13_conversation_repair(spark, f"{path}/none").count() == 0


def test_repaired_rows_in_order(spark):
    df = spark.createDataFrame([("c", 2, "assistant", "Hi."), ("c", 5, "assistant", " "), ("d", 1, "tool", "?")], "conv_id string, turn int, role string, text string")
    scratch = Scratch(spark)
    rows = C.intact(df)
    out = C.mended(rows, scratch.write(C.judged(rows, scratch), "audits")).orderBy("conv", "place").collect()
    assert [tuple(r) for r in out if r.conv == "c"] == [("c", 0, "user", ""), ("c", 1, "assistant", "Hi.")]
    for conv, mine in groupby(out, key=lambda r: r.conv):
        assert [r.place for r in mine] == list(range(len([r for r in out if r.conv == conv])))
    scratch.close()
