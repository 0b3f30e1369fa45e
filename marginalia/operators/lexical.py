"""Lexical search: BM25 over substrings or tokens, and positional search with sentence masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written

K1, B = 1.2, 0.75
SEGMENTS, BONUS = 16, 0.5


def _idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def _term(tf: Column, idf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return F.coalesce(F.try_divide(idf * tf * (k1 + 1), tf + k1 * (1 - b + b * F.try_divide(length, mean))), F.lit(0.0))


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "doc", k1: float = K1, b: float = B) -> DataFrame:
    """(id_col, score) of every document for the words of a query; terms match as substrings, a repeated word
    counts twice. Those that match nothing score 0: top() drops them after its limit, since a filter here would be
    pushed down and make every text anew for each term. One pass sums lengths and document frequencies of all words, a scalar subquery brings them to the
    second: no join and no shuffle beyond that one row."""
    k1, b = k1 or K1, b or B
    words = T.preprocess(F.lit(query))
    terms = docs.sparkSession.range(1).select(T.words(words)).first()[0]
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__d"))
    if not terms:
        return rows.select(id_col, F.lit(0.0).alias("score")).where("false")
    unique = list(dict.fromkeys(terms))
    seen = [F.sum(F.contains(F.col("__d"), F.lit(t)).cast("long")).alias(f"df{i}") for i, t in enumerate(unique)]
    stats = rows.agg(F.struct(F.count("__d").alias("n"), F.avg(T.word_count(F.col("__d"))).alias("mean"), *seen).alias("s"))
    rows = rows.withColumn("__s", stats.scalar())
    length = T.word_count(F.col("__d"))
    parts = rows.select(id_col, "__s", length.alias("__n"), *[T.substring_count(F.col("__d"), t).alias(f"__tf{i}") for i, t in enumerate(unique)])
    score = sum((F.lit(terms.count(t)) * _term(F.col(f"__tf{i}"), _idf(F.col("__s.n"), F.col(f"__s.df{i}")), F.col("__n"), F.col("__s.mean"), k1, b) for i, t in enumerate(unique)), F.lit(0.0))
    return parts.select(id_col, score.alias("score"))


def bm25_tokens(docs: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "doc", query_id: str = "query_id", query_col: str = "query", k1: float = K1, b: float = B) -> DataFrame:
    """Many queries at once: (query_id, id_col, score), terms match as whole tokens. Postings are counted by document
    and token before any shuffle, and only query tokens are joined with. Postings and the queries' tokens are written, so
    that texts are split once and small tables are known to be small; postings are dealt by document, so that a document's
    scores, of which there may be one for each query, are summed where they are made."""
    wanted = queries.select(F.col(query_id), F.explode(T.words(T.preprocess(F.col(query_col)))).alias("token")).groupBy(query_id, "token").agg(F.count(F.lit(1)).alias("times"))
    wanted = written(wanted, "query-words")
    split = docs.select(F.col(id_col), T.words(F.col(text_col)).alias("__w"))
    tokens = split.select(id_col, F.size("__w").alias("len"), F.explode("__w").alias("token"))
    freq = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"))
    freq = written(freq, "query-postings")
    stats = docs.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(T.word_count(F.col(text_col))).alias("mean")).alias("s"))
    df = written(freq.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "query-frequencies")
    each = freq.repartition(id_col).join(df, "token").withColumn("__s", stats.scalar())
    each = each.select(id_col, "token", _term(F.col("tf"), _idf(F.col("__s.n"), F.col("df")), F.col("len"), F.col("__s.mean"), k1, b).alias("__t"))
    scored = each.join(wanted, "token")
    term = F.col("times") * F.col("__t")
    return scored.groupBy(query_id, id_col).agg(F.sum(term).alias("score"))


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "doc", segments: int = SEGMENTS, only: list[str] | None = None) -> DataFrame:
    """(id_col, token, freq, mask, tokens): occurrences of a token in a document, the sentences it is in as bits
    (all from the last bit's on share it), and how many tokens the document has. The sentence number goes up only
    after sentences of more than one token. A document's positions are an array, so no row order is shuffled for. only: the
    tokens wanted; others are dropped within the arrays, before they become rows."""
    if not 0 < segments <= 31:
        raise ValueError("segments must be from 1 to 31")
    split = F.filter(F.transform(F.split(F.col(text_col), r"[.!?]+"), T.query_tokens), lambda x: F.size(x) > 0)
    rows = docs.select(F.col(id_col), split.alias("__s")).where(F.size("__s") > 0)
    step = F.aggregate(
        "__s",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda s, x: F.struct((s["at"] + F.when(F.size(x) > 1, 1).otherwise(0)).alias("at"), F.array_append(s["out"], F.least(s["at"], F.lit(segments - 1))).alias("out")),
        lambda s: s["out"],
    )
    total = F.aggregate("__s", F.lit(0), lambda n, x: n + F.size(x))
    places = F.arrays_zip(F.col("__s").alias("words"), step.alias("seg"))
    if only is not None:
        wanted = F.array(*[F.lit(w) for w in dict.fromkeys(only)]).cast("array<string>")
        places = F.filter(F.transform(places, lambda p: F.struct(F.filter(p["words"], lambda w: F.array_contains(wanted, w)).alias("words"), p["seg"].alias("seg"))), lambda p: F.size(p["words"]) > 0)
    each = rows.select(id_col, total.alias("tokens"), F.explode(places).alias("p"))
    each = each.select(id_col, "tokens", F.expr("shiftleft(1, p.seg)").alias("bit"), F.explode("p.words").alias("token"))
    return each.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("freq"), F.bit_or("bit").alias("mask"), F.max("tokens").alias("tokens"))


def positional_search(index: DataFrame, query: str, id_col: str = "id", bonus: float = BONUS) -> DataFrame:
    """(id_col, score): for each query token in turn freq**2 / tokens + 1, and a bonus for each sentence that it shares
    with earlier tokens of the query. A document has a row for each token of the query at most."""
    tokens = index.sparkSession.range(1).select(T.query_tokens(F.lit(query))).first()[0]
    if not tokens:
        return index.select(id_col, F.lit(0.0).alias("score")).where("false")
    asked = index.sparkSession.createDataFrame(list(enumerate(tokens)), "turn int, token string")
    hits = index.join(F.broadcast(asked), "token")  # the words of one query
    before = Window.partitionBy(id_col).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = F.bit_count(F.coalesce(F.bit_or("mask").over(before), F.lit(0)).bitwiseAND(F.col("mask")))
    scored = hits.select(id_col, (F.col("freq") * F.col("freq") / F.col("tokens") + 1 + bonus * near).alias("s"))
    return scored.groupBy(id_col).agg(F.sum("s").alias("score"))


def top(scored: DataFrame, k: int, id_col: str = "id", positive: bool = False) -> DataFrame:
    """The k best by score, then id; only positive scores if asked for."""
    best = scored.orderBy(F.desc("score"), F.col(id_col)).limit(k)
    return best.where("score > 0") if positive else best


def fuse(sparse: DataFrame, dense: DataFrame, alpha: float = 0.5, limit: int = 10, id_col: str = "id") -> DataFrame:
    """Hybrid fusion: scores over their lists' largest (0 where that isn't positive), (1 - alpha) * sparse + alpha *
    dense, a missing one 0. Each list is the top 3 * limit (sparse ones only if positive); several dense rows of a note count with their best."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")

    def scaled(df: DataFrame, out: str, positive: bool) -> DataFrame:
        df = df.groupBy(id_col).agg(F.max("score").alias("score"))
        df = top(df, 3 * limit, id_col, positive)
        high = F.max("score").over(Window.partitionBy(F.lit(0)))  # over 3 * limit rows
        return df.select(id_col, F.when(high > 0, F.col("score") / high).otherwise(0.0).alias(out))

    both = scaled(sparse, "sparse_score", True).join(scaled(dense, "dense_score", False), id_col, "full_outer")
    score = (1 - alpha) * F.coalesce("sparse_score", F.lit(0.0)) + alpha * F.coalesce("dense_score", F.lit(0.0))
    return both.select(id_col, "sparse_score", "dense_score", score.alias("score")).orderBy(F.desc("score"), id_col).limit(limit)
