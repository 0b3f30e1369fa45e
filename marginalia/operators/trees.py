"""Hierarchies given as (id, parent_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch


def descendants(forest: DataFrame, start: str | Column) -> DataFrame:
    """(id, root, depth) of the rows that meet `start` and of everything below them. Level by level, one join each, as
    deep as there are rows; a row that a root has reached already isn't followed again, so cycles end."""
    scratch = Scratch(forest.sparkSession)
    edges = forest.select(F.col("id").alias("child"), F.col("parent_id").alias("id"))
    levels = [scratch.write(forest.where(start).select("id", F.col("id").alias("root"), F.lit(0).alias("depth")), "level")]
    while not levels[-1].isEmpty():
        below = levels[-1].join(edges, "id").select(F.col("child").alias("id"), "root", (F.col("depth") + 1).alias("depth"))
        seen = reduce(DataFrame.union, levels).select("id", "root")
        levels.append(scratch.write(below.dropDuplicates(["id", "root"]).join(seen, ["id", "root"], "left_anti"), "level"))
    return scratch.result(reduce(DataFrame.union, levels), "descendants")
