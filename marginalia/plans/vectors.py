"""Queries of vector search and of edges between vectors, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import graphs as G
from ..operators import neighbour_graph as N
from ..operators import vectors as X
from ..sources.tables import table


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _against_first(spark, d):
    v = _vectors(spark, d)
    return v.withColumn("q", v.where("id = 0").select("vec").scalar())


def knn_cosine(spark, d):
    s = _against_first(spark, d).select("id", V.cosine(F.col("vec"), F.col("q"), F.lit(0.0)).alias("s"))
    return s.orderBy(F.desc("s"), "id").limit(10).select("id", F.round("s", 6).alias("score"), F.round(1 - F.col("s"), 6).alias("distance"))


def knn_euclidean(spark, d):
    s = _against_first(spark, d).select("id", V.euclidean_similarity(F.col("vec"), F.col("q")).alias("s"))
    return s.orderBy(F.desc("s"), "id").limit(10).select("id", F.round("s", 6).alias("score"))


def knn_all(spark, d):
    """Ten neighbours of every twentieth vector among all."""
    v = _vectors(spark, d)
    return X.knn(v, 10, queries=v.where("id % 20 = 0")).select("source", "target", F.round("score", 6).alias("score"), "rank")


def knn_dim_guard(spark, d):
    v = _vectors(spark, d).withColumn("vec", F.when(F.col("id") % 7 == 0, F.slice("vec", 1, 63)).otherwise(F.col("vec")))
    return X.guarded(v, 64).select("id", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("norm2"))


def semantic_edges_pairwise(spark, d):
    return X.similar_pairs(_vectors(spark, d), 0.3).select("source", "target", F.round("weight", 6).alias("weight"))


def semantic_edges_knn(spark, d):
    return X.semantic_edges(X.knn(_vectors(spark, d), 10), 0.3).select("source", "target", F.round("weight", 6).alias("weight"))


def sequential_edges(spark, d):
    c = table(spark, d, "conversations").withColumn("id", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return X.sequential_edges(c, "conv_id", "turn", "id").select("source", "target", "weight")


def hierarchical_edges(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("r_name").alias("source"), F.col("n_name").alias("target"), F.lit(1.0).alias("weight"))


def neighbors(spark, d):
    """Of vector 3, over semantic and sequential edges; of the semantic ones only its own are made."""
    pairs = X.similar_to(_vectors(spark, d), 3, 0.3)
    sem = pairs.select("source", "target", F.lit("semantic").alias("type"), "weight")
    seq = _vectors(spark, d).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit("sequential").alias("type"), F.lit(1.0).alias("weight"))
    return G.neighbours(sem.union(seq), 3).select("id", "type", F.round("weight", 6).alias("weight"))


def sentence_lookahead_similarity(spark, d):
    """Mean similarity of each vector with the next three."""
    v = _vectors(spark, d)
    a = v.select("id", "vec", F.explode(F.sequence(F.col("id") + 1, F.col("id") + 3)).alias("other"))
    j = a.join(v.select(F.col("id").alias("other"), F.col("vec").alias("next")), "other")
    return j.groupBy("id").agg(F.round(F.avg(V.cosine(F.col("vec"), F.col("next"), F.lit(0.0))), 6).alias("similarity"))


def dynamic_threshold(spark, d):
    v = _vectors(spark, d)
    a = v.select("id", "vec", F.explode(F.sequence(F.col("id") + 1, F.col("id") + 3)).alias("other"))
    j = a.join(v.select(F.col("id").alias("other"), F.col("vec").alias("next")), "other")
    s = j.groupBy("id").agg(F.avg(V.cosine(F.col("vec"), F.col("next"), F.lit(0.0))).alias("s"))
    return s.agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.var_pop("s"), 6).alias("variance"), F.round(F.greatest(F.lit(0.4), F.least(F.lit(0.8), 0.5 + F.var_pop("s") / 2)), 6).alias("threshold"))


def _walk(spark, d, steps):
    s = _against_first(spark, d).select("id", V.cosine(F.col("vec"), F.col("q"), F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return X.similarity_walk(_vectors(spark, d), s, 0.3, steps)


def walk_expected_fixed(spark, d):
    return _walk(spark, d, 4).select("id", F.round("score", 6).alias("score"))


def graphrag_query(spark, d):
    """Twice the wanted seeds by similarity, 100 steps of walking, the best ten."""
    return _walk(spark, d, 100).orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


def ann_lsh_recall(spark, d):
    v = _vectors(spark, d)
    q = v.where("id % 20 = 0")
    found = X.lsh_knn(v, q, 10, 64).select("source", "target")
    true = X.knn(v, 10, queries=q).select("source", "target")
    return true.join(found.withColumn("hit", F.lit(1)), ["source", "target"], "left").agg(F.count(F.lit(1)).alias("wanted"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def knn_graph(spark, d):
    """The ten nearest of every vector as the neighbour graph has them, itself left out."""
    g, _ = N.build(_vectors(spark, d))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))
    return g.withColumn("rank", rank).where("rank <= 10").select("source", "target", "rank", F.round("score", 6).alias("score"))


def graph_search(spark, d):
    """The ten nearest of each query by a walk over the neighbour graph, and with how many vectors it was compared."""
    v = _vectors(spark, d)
    g, unit = N.build(v)
    return N.search(g, unit, v.where("id % 20 = 0"), 10).select("source", "target", "rank", F.round("score", 6).alias("score"), "scored")


QUERIES = {f.__name__: f for f in (knn_cosine, knn_euclidean, knn_all, knn_dim_guard, semantic_edges_pairwise, semantic_edges_knn, sequential_edges, hierarchical_edges, neighbors, sentence_lookahead_similarity, dynamic_threshold, walk_expected_fixed, graphrag_query, ann_lsh_recall, knn_graph, graph_search)}

_V = "v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings)"
_COS = "coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})), 0), 0)"
_PAIRS = f"p as (select a.id as source, b.id as target, {_COS.format(a='a.vec', b='b.vec')} as weight from v a join v b on a.id < b.id), e as (select * from p where weight > 0.3)"
_ALL = f"n as (select a.id as source, b.id as target, {_COS.format(a='a.vec', b='b.vec')} as score from v a, v b), k as (select *, row_number() over (partition by source order by score desc, target) as rank from n)"
_AHEAD = f"s as (select a.id, avg({_COS.format(a='a.vec', b='b.vec')}) as s from v a join v b on b.id between a.id + 1 and a.id + 3 group by a.id)"


def _walk_sql(steps: int) -> str:
    out = f"with {_V}, {_PAIRS}, ed as (select source, target, weight from e union all select target, source, weight from e), tot as (select source, sum(weight) as t from ed group by 1), m as (select ed.source, target, weight / t as p from ed join tot using (source)), q as (select vec as qv from v where id = 0), seeds as (select id, {_COS.format(a='vec', b='qv')} as p from v, q order by p desc, id limit 20), alone as (select id from seeds where id not in (select source from m)), p0 as (select id, p from seeds)"
    for i in range(1, steps):
        out += f", p{i} as (select id, sum(p) as p from (select m.target as id, 0.85 * w.p * m.p as p from p{i - 1} w join m on w.id = m.source union all select id, 0.85 * p from p{i - 1} where id in (select id from alone) union all select id, 0.15 * p from seeds) group by id)"
    union = " union all ".join(f"select id, p from p{i}" for i in range(steps))
    return f"{out} select id, round(sum(p) / {steps}, 6) as score from ({union}) group by id"


def _long_walk_sql(steps: int) -> str:
    """_walk_sql() as a recursion, whose seeds come anew in each step."""
    head = _walk_sql(1).split(", p0 as")[0].replace("with ", "with recursive ", 1)
    return f"""{head}, w(step, id, p) as (select 0, id, p from seeds union all select step + 1, id, sum(p) from (select w.step, m.target as id, 0.85 * w.p * m.p as p from w join m on w.id = m.source
union all select step, id, 0.85 * p from w where id in (select id from alone) union all select s.step, seeds.id, 0.15 * seeds.p from seeds, (select distinct step from w) s) where step < {steps - 1} group by step, id),
f as (select id, sum(p) / {steps} as score from w group by id) select id, round(score, 6) as score from f order by f.score desc, id limit 10"""


ORACLE_SQL = {
    "graphrag_query": _long_walk_sql(100),
    "knn_cosine": f"with {_V}, q as (select vec as qv from v where id = 0), s as (select id, {_COS.format(a='vec', b='qv')} as s from v, q) select id, round(s, 6) as score, round(1 - s, 6) as distance from s order by s desc, id limit 10",
    "knn_euclidean": f"with {_V}, q as (select vec as qv from v where id = 0), s as (select id, 1 / (1 + list_distance(vec, qv)) as s from v, q) select id, round(s, 6) as score from s order by s desc, id limit 10",
    "knn_all": f"with {_V}, {_ALL} select source, target, round(score, 6) as score, cast(rank as integer) as rank from k where rank <= 10 and source % 20 = 0",
    "knn_dim_guard": f"with {_V} select id, round(list_dot_product(vec, vec), 6) as norm2 from v where id % 7 <> 0",
    "semantic_edges_pairwise": f"with {_V}, {_PAIRS} select source, target, round(weight, 6) as weight from e",
    "semantic_edges_knn": f"with {_V}, {_ALL}, t as (select source, target, round(score, 6) as weight from k where rank <= 10 and source <> target and score > 0.3) select source, target, weight from t union select target, source, weight from t",
    "sequential_edges": "with t as (select conv_id || '_' || turn as source, lead(conv_id || '_' || turn) over (partition by conv_id order by turn) as target from conversations) select source, target, cast(1 as double) as weight from t where target is not null",
    "hierarchical_edges": "select r_name as source, n_name as target, cast(1 as double) as weight from nation join region on n_regionkey = r_regionkey",
    "neighbors": f"with {_V}, {_PAIRS}, a as (select source, target, 'semantic' as type, weight from e union all select id, id + 1, 'sequential', 1.0 from v), b as (select target as id, type, weight from a where source = 3 union all select source, type, weight from a where target = 3), r as (select *, row_number() over (partition by id order by type, weight) as r from b) select id, type, round(cast(weight as double), 6) as weight from r where r = 1",
    "sentence_lookahead_similarity": f"with {_V}, {_AHEAD} select id, round(s, 6) as similarity from s",
    "dynamic_threshold": f"with {_V}, {_AHEAD} select round(avg(s), 6) as mean, round(var_pop(s), 6) as variance, round(greatest(0.4, least(0.8, 0.5 + var_pop(s) / 2)), 6) as threshold from s",
    "walk_expected_fixed": _walk_sql(4),
}
