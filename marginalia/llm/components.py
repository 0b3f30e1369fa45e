"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

JUMPS = 3


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(v, comp) for each vertex of links (a long, b long): the smallest vertex that it is connected with.

    Each round points every vertex at its smallest neighbour, or itself, follows the pointers 2**JUMPS steps, and
    goes on with the graph of what the pointers lead to, until no link is left; vertices remember where they went.
    Tables of a round are written to the shared folder and deleted once the next round has read them; the returned one
    stays (in scratch, if given, for the caller to delete). A vertex of any degree is summed before its shuffle.
    """
    scratch = Scratch(links.sparkSession) if scratch is None else scratch
    edges = scratch.write(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = scratch.write(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")), "pointers")
        to = first
        for _ in range(JUMPS):
            over = to.select(F.col("v").alias("p"), F.col("p").alias("q"))
            to = to.join(over, "p").select("v", F.col("q").alias("p"))
        to = scratch.write(to, "pointers")
        scratch.drop(first)
        on = to.select(F.col("v").alias("comp"), "p")
        before = found
        found = scratch.write(to.select("v", F.col("p").alias("comp")) if before is None else before.join(on, "comp", "left").select("v", F.coalesce("p", "comp").alias("comp")), "components")
        a, b = to.select(F.col("v").alias("a"), F.col("p").alias("pa")), to.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(a, "a").join(b, "b").where("pa <> pb")
        after = scratch.write(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        scratch.drop(edges, to, *([] if before is None else [before]))
        edges = after
    if found is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("comp"))
    scratch.drop(edges)
    return found
